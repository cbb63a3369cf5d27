"""DuckDB restatement of the labelling rules, used as the correctness oracle.

Written independently from the Spark Column code: the same rules, stated as
SQL over the pre-registered test views.  Helpers here return SQL fragments;
``CTES`` chains them into the classified corpus.
"""

from __future__ import annotations

from ..functions import constants as C

WS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
NON_WS = r"[^\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
NON_WORD_NON_SPACE = r"[^\p{L}\p{N}_\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"


def lit(s: str) -> str:
    """SQL string literal; control characters go through chr()."""
    parts, buf = [], ""
    for ch in s:
        if ord(ch) < 32:
            if buf:
                parts.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not parts:
        parts.append("'" + buf.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{NON_WS}+')"


def word_count(x: str) -> str:
    return f"CAST(len({words(x)}) AS BIGINT)"


def contains_any(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(n)})" for n in needles) + ")"


def short_or_empty(x: str, n: int = C.PRE_FILTER_MIN_STRIPPED) -> str:
    return f"({x} IS NULL OR length({strip(x)}) < {n})"


def repetitive(x: str) -> str:
    w = words(x)
    k = C.REPETITION_PHRASE_WORDS
    return (
        f"(length({x}) > {C.REPETITION_MIN_CHARS} AND len({w}) > {C.REPETITION_MIN_WORDS} AND "
        f"contains(array_to_string(list_slice({w}, {k + 1}, len({w})), ' '), "
        f"array_to_string(list_slice({w}, 1, {k}), ' ')))"
    )


def skip_reason(x: str) -> str:
    low = f"lower({x})"
    st = strip(x)
    return (
        "CASE "
        f"WHEN length({x}) > {C.MAX_UTTERANCE_CHARS} THEN 'extreme_length' "
        f"WHEN {contains_any(low, C.CORRUPTION_MARKERS)} THEN 'corrupted data' "
        f"WHEN {repetitive(x)} THEN 'repetitive corruption' "
        f"WHEN length({x}) < {C.MEANINGFUL_MIN_LENGTH} AND NOT {contains_any(low, C.EMOTIONAL_KEYWORDS)} "
        "THEN 'too short and no emotional content' "
        f"WHEN length({st}) < {C.NOISE_MIN_STRIPPED} THEN 'too short' "
        f"WHEN length(translate({st}, {lit(C.PUNCT_REMOVED)}, '')) < {C.PUNCT_MIN_REMAINING} "
        "THEN 'mostly punctuation' "
        "ELSE NULL END"
    )


def alphabetical(idx: str) -> str:
    names = C.ALPHABETICAL_EMOTIONS + [f"unlisted_{len(C.ALPHABETICAL_EMOTIONS) + k}" for k in range(2)]
    return "list_value(" + ", ".join(lit(n) for n in names) + f")[({idx}) + 1]"


SLOTS = len(C.ALPHABETICAL_EMOTIONS) + 2
TRAIT_COLS = ", ".join(C.TRAIT_COLUMNS)


def emotion_values() -> str:
    rows = []
    for name, (skip, scores) in C.EMOTIONS.items():
        vals = ", ".join(d(v) for v in C.sparse_to_dense(scores))
        rows.append(f"({lit(name)}, {str(skip).upper()}, {vals})")
    return f"(VALUES {', '.join(rows)}) AS t(emotion, skip, {TRAIT_COLS})"


def numeric_values() -> str:
    rows = []
    for i, (name, skip, scores) in C.NUMERIC_EMOTIONS.items():
        vals = ", ".join(d(v) for v in C.sparse_to_dense(scores))
        rows.append(f"(CAST({i} AS BIGINT), {lit(name)}, {str(skip).upper()}, {vals})")
    return f"(VALUES {', '.join(rows)}) AS t(emotion_id, emotion_name, skip, {TRAIT_COLS})"


def finish(source: str, u: str, origin: str, tag: str, traits: list[str], reason: str, label: str) -> str:
    tcols = ", ".join(f"CAST({t} AS DOUBLE) AS {c}" for t, c in zip(traits, C.TRAIT_COLUMNS))
    return (
        f"{u} AS utterance, {lit(source)} AS source, {origin} AS origin_id, {tag} AS original_tag, "
        f"CAST(length({u}) AS BIGINT) AS utterance_length, {word_count(u)} AS word_count, "
        f"{tcols}, CAST({label} AS VARCHAR) AS label, {reason} AS reason"
    )


def meaningful(u: str) -> str:
    return f"CASE WHEN {u} IS NULL THEN 'short' ELSE {skip_reason(u)} END"


def _roles() -> str:
    listener = C.sparse_to_dense(C.LISTENER_TRAITS)
    is_sp = "coalesce(r.speaker_idx = s.emotional_speaker, FALSE)"
    traits = [f"CASE WHEN {is_sp} THEN e.{c} ELSE {d(listener[i])} END" for i, c in enumerate(C.TRAIT_COLUMNS)]
    reason = (
        "CASE WHEN e.skip IS NULL THEN 'unmapped' "
        f"WHEN {short_or_empty('r.utterance')} THEN 'short' "
        f"WHEN {is_sp} AND e.skip THEN 'skip_flag' "
        f"ELSE {skip_reason('r.utterance')} END"
    )
    origin = "r.conv_id || '_turn_' || CAST(r.utterance_idx AS VARCHAR)"
    tag = f"r.context || CASE WHEN {is_sp} THEN '_speaker' ELSE '_listener' END"
    return f"""
roles_src AS (
  SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS BIGINT) AS utterance_idx, role AS speaker_idx,
         {alphabetical(f'conv_id % {SLOTS}')} AS context, text AS utterance
  FROM conversations),
emotion_dim AS (SELECT * FROM {emotion_values()}),
numeric_dim AS (SELECT * FROM {numeric_values()}),
first_speakers AS (
  SELECT conv_id, arg_min(speaker_idx, utterance_idx) AS emotional_speaker
  FROM roles_src WHERE context IN (SELECT emotion FROM emotion_dim) GROUP BY conv_id),
src_roles AS (
  SELECT {finish('EmpatheticDialogues', 'r.utterance', origin, tag, traits, reason, 'r.context')}
  FROM roles_src r LEFT JOIN emotion_dim e ON r.context = e.emotion
  LEFT JOIN first_speakers s ON r.conv_id = s.conv_id)"""


def _dialogue() -> str:
    reason = (
        "CASE WHEN x.n_emotions <= 0 THEN 'no_emotions' "
        "WHEN n.emotion_name IS NULL THEN 'unmapped' WHEN n.skip THEN 'skip_flag' "
        f"ELSE {meaningful('x.utterance')} END"
    )
    origin = "CAST(x.row_id AS VARCHAR) || '_' || CAST(x.pos AS VARCHAR)"
    traits = [f"n.{c}" for c in C.TRAIT_COLUMNS]
    return f"""
dlg_sizes AS (SELECT conv_id, count(*) AS n_utterances FROM conversations GROUP BY conv_id),
dlg_rows AS (
  SELECT c.conv_id AS row_id, CAST(c.turn AS BIGINT) AS pos, c.text AS utterance,
         s.n_utterances - CASE WHEN c.conv_id % 5 = 0 THEN 1 ELSE 0 END AS n_emotions,
         CASE WHEN c.turn < s.n_utterances - CASE WHEN c.conv_id % 5 = 0 THEN 1 ELSE 0 END
              THEN (c.conv_id + c.turn) % 8 END AS emotion_id
  FROM conversations c JOIN dlg_sizes s ON c.conv_id = s.conv_id),
src_dialogue AS (
  SELECT {finish('DailyDialog', 'x.utterance', origin, 'n.emotion_name', traits, reason,
                 'CASE WHEN x.n_emotions > 0 THEN coalesce(x.emotion_id, 0) END')}
  FROM dlg_rows x LEFT JOIN numeric_dim n ON CAST(coalesce(x.emotion_id, 0) AS BIGINT) = n.emotion_id)"""


def _int_labels() -> str:
    name = "CASE " + " ".join(f"WHEN x.label = {k} THEN {lit(v)}" for k, v in C.INT_LABELS.items()) + " END"
    recoded = "CASE " + " ".join(f"WHEN x.name = {lit(k)} THEN {lit(v)}" for k, v in C.INT_LABEL_RECODE.items()) \
        + " ELSE x.name END"
    reason = (
        f"CASE WHEN {short_or_empty('x.text')} THEN 'short' WHEN x.name IS NULL THEN 'bad_label' "
        "WHEN e.skip IS NULL THEN 'unmapped' WHEN e.skip THEN 'skip_flag' "
        f"ELSE {skip_reason('x.text')} END"
    )
    traits = [f"coalesce(e.{c}, {d(0)})" for c in C.TRAIT_COLUMNS]
    return f"""
int_src0 AS (SELECT doc_id % 7 AS label, text, doc_id AS row_idx FROM documents),
int_src1 AS (SELECT x.*, {name} AS name FROM int_src0 x),
int_src AS (SELECT x.*, {recoded} AS emotion FROM int_src1 x),
src_int AS (
  SELECT {finish('EmotionLines', 'x.text', "'row_' || CAST(x.row_idx AS VARCHAR)", 'x.emotion', traits, reason,
                 'x.emotion')}
  FROM int_src x LEFT JOIN emotion_dim e ON x.emotion = e.emotion)"""


def _string_labels() -> str:
    name = alphabetical(f"doc_id % {SLOTS}")
    reason = (
        f"CASE WHEN x.emotion IS NULL OR x.emotion = '' OR {short_or_empty('x.text')} THEN 'short' "
        "WHEN e.skip IS NULL THEN 'unmapped' WHEN e.skip THEN 'skip_flag' "
        f"ELSE {skip_reason('x.text')} END"
    )
    traits = [f"coalesce(e.{c}, {d(0)})" for c in C.TRAIT_COLUMNS]
    return f"""
str_src AS (
  SELECT lower(CASE WHEN doc_id % 2 = 0 THEN upper({name}) ELSE {name} END) AS emotion, text, doc_id AS row_idx
  FROM documents),
src_string AS (
  SELECT {finish('MELD', 'x.text', 'CAST(x.row_idx AS VARCHAR)', 'x.emotion', traits, reason, 'x.emotion')}
  FROM str_src x LEFT JOIN emotion_dim e ON x.emotion = e.emotion)"""


def activation_ctes() -> str:
    """Trait sums of the activation source: active columns joined with the
    scores of the emotion that each column stands for, plus the dimensions."""
    columns = ", ".join(f"({i}, {lit(c)}, {lit(e)})" for i, (c, e) in enumerate(C.ACTIVATIONS))
    scores = ", ".join(f"({lit(e)}, {lit(t)}, {d(v)})" for e, (skip, traits) in C.EMOTIONS.items() if not skip
                       for t, v in traits.items())
    dims = ", ".join(f"({100 + i}, {lit(c)}, {lit(t)})" for i, (c, t) in enumerate(C.DIMENSIONS))
    names = [c for c, _ in C.ACTIVATIONS]
    pivot = ", ".join(
        f"greatest({d(-1)}, least({d(1)}, coalesce(list_sum(list(part ORDER BY ord) FILTER (trait = {lit(t)})), {d(0)}))) AS raw_{c}"
        for t, c in zip(C.TRAITS, C.TRAIT_COLUMNS))
    return f"""
act_columns AS (SELECT * FROM (VALUES {columns}) AS t(ord, col, emotion)),
act_scores AS (SELECT * FROM (VALUES {scores}) AS t(emotion, trait, score)),
act_dims AS (SELECT * FROM (VALUES {dims}) AS t(ord, col, trait)),
act_long AS (UNPIVOT act_src ON {', '.join(names)} INTO NAME col VALUE a),
act_parts AS (
  SELECT l.row_idx, c.ord, s.trait, s.score * l.a AS part
  FROM act_long l JOIN act_columns c ON c.col = l.col JOIN act_scores s ON s.emotion = c.emotion
  WHERE l.a > {d(C.ACTIVATION_MIN)} AND NOT isnan(l.a)
  UNION ALL
  SELECT l.row_idx, m.ord, m.trait, (l.v - {d(C.DIMENSION_CENTER)}) * {d(C.DIMENSION_SCALE)}
  FROM (UNPIVOT act_src ON {', '.join(c for c, _ in C.DIMENSIONS)} INTO NAME col VALUE v) l JOIN act_dims m ON m.col = l.col
  WHERE l.v > 0),
act_sums AS (SELECT s.row_idx, {pivot} FROM act_src s LEFT JOIN act_parts p USING (row_idx) GROUP BY s.row_idx)"""


def _activations() -> str:
    acts = ", ".join(f"CAST(abs(e.embedding[{k + 1}]) AS DOUBLE) AS {name}"
                     for k, (name, _) in enumerate(C.ACTIVATIONS))
    neutral = C.sparse_to_dense(C.EMOTIONS["neutral"][1])
    zero = " AND ".join(f"raw_{c} = 0" for c in C.TRAIT_COLUMNS)
    traits = [f"CASE WHEN {zero} AND x.major_emotion = 'neutral' THEN {d(neutral[i])} ELSE raw_{c} END"
              for i, c in enumerate(C.TRAIT_COLUMNS)]
    reason = f"CASE WHEN {short_or_empty('x.transcription')} THEN 'short' ELSE {skip_reason('x.transcription')} END"
    return f"""
act_src AS (
  SELECT e.vec_id AS row_idx, d.text AS transcription, 'vec_' || CAST(e.vec_id AS VARCHAR) || '.wav' AS file,
         CASE WHEN e.vec_id % 7 = 0 THEN 'neutral' ELSE 'unknown' END AS major_emotion, {acts},
         {d(1)} + CAST(e.vec_id % 9 AS DOUBLE) * {d(0.5)} AS EmoAct,
         {d(1)} + CAST((e.vec_id // 9) % 9 AS DOUBLE) * {d(0.5)} AS EmoVal,
         CASE WHEN e.vec_id % 10 = 0 THEN {d(0)} ELSE {d(3.5)} END AS EmoDom
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id),
{activation_ctes().strip()},
act_raw AS (SELECT x.*, y.* EXCLUDE (row_idx) FROM act_src x JOIN act_sums y USING (row_idx)),
src_act AS (
  SELECT {finish('IEMOCAP', 'x.transcription', 'x.file', "coalesce(x.major_emotion, 'unknown')", traits, reason,
                 'x.major_emotion')}
  FROM act_raw x)"""


CORPUS_COLS = "utterance, source, origin_id, original_tag, utterance_length, word_count, " + TRAIT_COLS


def dialogue_list_ctes() -> str:
    """Array dialogues of eight turns; ends in ``src_lists``."""
    reason = (
        "CASE WHEN x.n_emotions <= 0 THEN 'no_emotions' "
        "WHEN n.emotion_name IS NULL THEN 'unmapped' WHEN n.skip THEN 'skip_flag' "
        f"ELSE {meaningful('x.utterance')} END"
    )
    origin = "CAST(x.row_id AS VARCHAR) || '_' || CAST(x.pos AS VARCHAR)"
    traits = [f"n.{c}" for c in C.TRAIT_COLUMNS]
    return f"""
numeric_dim AS (SELECT * FROM {numeric_values()}),
lists AS (
  SELECT conv_id * 1000 + turn // 8 AS row_id, conv_id, list(text ORDER BY turn) AS u,
         list((conv_id + turn) % 8 ORDER BY turn) AS e
  FROM conversations GROUP BY conv_id, turn // 8),
counted_lists AS (
  SELECT *, CASE WHEN conv_id % 7 = 0 THEN 0 ELSE len(u) - CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END END AS n_emotions
  FROM lists),
list_rows AS (
  SELECT row_id, pos, u[pos + 1] AS utterance, n_emotions, CASE WHEN pos < n_emotions THEN e[pos + 1] END AS emotion_id
  FROM (SELECT *, unnest(range(0, len(u))) AS pos FROM counted_lists)),
src_lists AS (
  SELECT {finish('DailyDialog', 'x.utterance', origin, 'n.emotion_name', traits, reason,
                 'CASE WHEN x.n_emotions > 0 THEN coalesce(x.emotion_id, 0) END')}
  FROM list_rows x LEFT JOIN numeric_dim n ON CAST(coalesce(x.emotion_id, 0) AS BIGINT) = n.emotion_id)"""


def classified_ctes() -> str:
    """WITH-clause body ending in ``classified`` and ``corpus_raw``."""
    return ",".join([_roles(), _dialogue(), _int_labels(), _string_labels(), _activations()]) + f""",
classified AS (
  SELECT * FROM src_roles UNION ALL SELECT * FROM src_dialogue UNION ALL SELECT * FROM src_int
  UNION ALL SELECT * FROM src_string UNION ALL SELECT * FROM src_act),
corpus_raw AS (SELECT {CORPUS_COLS} FROM classified WHERE reason IS NULL)"""


def sample_hash(source: str, origin: str, salt: str) -> str:
    """Shared 32-bit hash: first 8 hex digits of md5 as a bigint."""
    return f"CAST(('0x' || substr(md5({lit(salt)} || '|' || {source} || '|' || {origin}), 1, 8)) AS BIGINT)"


def sampled_cte(salt: str) -> str:
    h = sample_hash("source", "origin_id", salt)
    cases = []
    for src, tag, rate in C.SAMPLING_STRATA:
        if tag is None:
            cases.append(f"WHEN source = {lit(src)} THEN {int(round(rate * 10000))}")
        else:
            cases.append(f"WHEN source = {lit(src)} AND original_tag = {lit(tag)} THEN {int(round(rate * 10000))}")
            cases.append(f"WHEN source = {lit(src)} AND original_tag <> {lit(tag)} THEN 10000")
            cases.append(f"WHEN source = {lit(src)} THEN 0")
    srcs = ", ".join(lit(s) for s in C.SAMPLING_SOURCES)
    return f""",
corpus AS (
  SELECT {CORPUS_COLS} FROM corpus_raw
  WHERE source IN ({srcs})
    AND {h} % 10000 < (CASE {' '.join(cases)} ELSE 10000 END))"""


def hash32(salt: str, *exprs: str) -> str:
    """Same as the Spark ``hash32``: md5(salt|e1|e2...) first 8 hex digits."""
    key = " || '|' || ".join([lit(salt)] + list(exprs))
    return f"CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT)"


# ---------------------------------------------------------------- seeds ---

def clean_seed(x: str) -> str:
    collapsed = f"regexp_replace({strip(x)}, '{WS}+', ' ', 'g')"
    return (
        f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL "
        f"WHEN {contains_any(f'lower({collapsed})', C.SEED_ARTIFACTS)} THEN NULL "
        f"WHEN length({strip(collapsed)}) < {C.SEED_MIN_CHARS} THEN NULL "
        f"WHEN length(regexp_replace({collapsed}, '{NON_WORD_NON_SPACE}', '', 'g')) < {C.SEED_MIN_WORD_CHARS} "
        f"THEN NULL ELSE {collapsed} END"
    )


def seed_reason(c: str, min_words: int = C.SEED_MIN_WORDS) -> str:
    n = word_count(c)
    low = f"lower({strip(c)})"
    pats = " OR ".join(f"regexp_matches({low}, {lit(p.replace(chr(92) + 's', WS))})"
                       for p in C.SIMPLE_SEED_PATTERNS)
    conj = ", ".join(lit(w) for w in C.CONJUNCTIONS)
    complexity = (
        f"(length({c}) - length(translate({c}, {lit(C.COMPLEXITY_PUNCT)}, '')) "
        f"+ len(list_filter({words(c)}, lambda w: lower(w) IN ({conj}))) "
        f"+ CASE WHEN {contains_any(low, C.DESCRIPTIVE_WORDS)} THEN 1 ELSE 0 END)"
    )
    return (
        f"CASE WHEN {c} IS NULL OR {c} = '' THEN 'empty' "
        f"WHEN {n} < {min_words} THEN 'too_short' WHEN {n} > {C.SEED_MAX_WORDS} THEN 'too_long' "
        f"WHEN {pats} THEN 'too_simple' "
        f"WHEN {contains_any(low, C.QUESTION_WORDS)} AND {n} < {C.QUESTION_MAX_WORDS} THEN 'simple_question' "
        f"WHEN {complexity} = 0 AND {n} < {C.BASIC_MAX_WORDS} THEN 'too_basic' "
        "ELSE 'good_seed' END"
    )


def seed_ctes() -> str:
    targets = ", ".join(lit(e) for e in C.NEUTRAL_EMOTIONS + C.LOW_INTENSITY_EMOTIONS)
    return f"""
seed_src AS (SELECT lower({alphabetical(f'conv_id % {SLOTS}')}) AS emotion, text, conv_id, turn FROM conversations),
seed_clean AS (SELECT conv_id, turn, emotion, {clean_seed('text')} AS cleaned FROM seed_src),
seed_classified AS (
  SELECT conv_id, turn, emotion, cleaned, emotion IN ({targets}) AS target_emotion,
         CASE WHEN cleaned IS NULL THEN 'cleaning_failed' ELSE {seed_reason('cleaned')} END AS seed_reason
  FROM seed_clean),
seed_funnel AS (
  SELECT *, CASE WHEN NOT target_emotion THEN 'not_target_emotion' ELSE seed_reason END AS reason
  FROM seed_classified),
seed_top AS (
  SELECT cleaned AS utterance, 'MELD' AS source, emotion, CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR)
         AS origin_id, {word_count('cleaned')} AS word_count, conv_id, turn
  FROM seed_funnel WHERE reason = 'good_seed' ORDER BY conv_id, turn LIMIT {C.SEED_MAX_SAMPLES}),
seed_all AS (
  SELECT cleaned AS utterance, {word_count('cleaned')} AS word_count FROM seed_funnel WHERE reason = 'good_seed'),
seed_pool AS (
  SELECT utterance AS seed FROM seed_all
  WHERE word_count > {C.LOADER_MIN_WORDS_EXCL} AND word_count < {C.LOADER_MAX_WORDS_EXCL})"""


# -------------------------------------------------------------- buckets ---

def bucket_list() -> str:
    parts = [f"CASE WHEN trait_{t} >= {d(C.POLE_HIGH)} THEN '{t}_plus' "
             f"WHEN trait_{t} <= {d(C.POLE_LOW)} THEN '{t}_minus' END" for t in C.TRAITS]
    return f"list_filter(list_value({', '.join(parts)}), lambda b: b IS NOT NULL)"


def prompt_sql() -> str:
    parts = []
    for t in C.TRAITS:
        pos, neg = C.TRAIT_DESCRIPTIONS[t]
        parts.append(f"CASE WHEN trait_{t} > {d(C.DESCRIPTION_HIGH)} THEN {lit(pos)} "
                     f"WHEN trait_{t} < {d(C.DESCRIPTION_LOW)} THEN {lit(neg)} END")
    descs = f"list_filter(list_value({', '.join(parts)}), lambda x: x IS NOT NULL)"
    return (f"CASE WHEN len({descs}) = 0 THEN {lit(C.PROMPT_NEUTRAL)} "
            f"ELSE {lit(C.PROMPT_PREFIX)} || array_to_string({descs}, ', ') || {lit(C.PROMPT_SUFFIX)} END")


def bucket_values() -> str:
    rows = []
    for b in C.BUCKETS:
        desc, templates = C.BUCKET_STYLES[b]
        tl = "list_value(" + ", ".join(lit(x) for x in templates) + ")"
        rows.append(f"({lit(b)}, {lit(desc)}, {tl})")
    return f"(VALUES {', '.join(rows)}) AS t(bucket, description, templates)"


def bucket_ctes(target: int = C.TARGET_PER_BUCKET) -> str:
    return f""",
bucket_rows AS (SELECT * EXCLUDE (buckets), unnest(buckets) AS bucket
                FROM (SELECT *, {bucket_list()} AS buckets FROM corpus) WHERE len(buckets) > 0),
bucket_dim AS (SELECT * FROM {bucket_values()}),
bucket_counts AS (SELECT bucket, count(*) AS existing FROM bucket_rows GROUP BY bucket),
bucket_needs AS (
  SELECT d.bucket, d.description, d.templates, CAST(coalesce(c.existing, 0) AS BIGINT) AS existing,
         CAST(greatest({target} - coalesce(c.existing, 0), 0) AS BIGINT) AS need
  FROM bucket_dim d LEFT JOIN bucket_counts c ON d.bucket = c.bucket)"""


# --------------------------------------------------------------- dedup ---

def minhash_ctes(table: str = "documents", id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> str:
    from ..operators.dedup import EMPTY_SIGNATURE, PRIME, lsh_params, permutations
    perms = permutations()
    bands, rows = lsh_params()
    mins = ", ".join(f"coalesce(min(({a} * h.hv + {b}) % {PRIME}), {EMPTY_SIGNATURE}) AS m{i}"
                     for i, (a, b) in enumerate(perms))
    band_sel = " UNION ALL ".join(
        f"SELECT node, {j} AS band, md5(concat_ws(',', '{j}', "
        + ", ".join(f"CAST(m{j * rows + k} AS VARCHAR)" for k in range(rows)) + f")) AS band_key FROM {prefix}sigs"
        for j in range(bands))
    return f"""
{prefix}toks AS (SELECT {id_col} AS node, regexp_extract_all(lower({text_col}), '{NON_WS}+') AS t FROM {table}),
{prefix}shingled AS (
  SELECT node, CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(0, len(t) - 2),
         lambda i: array_to_string(list_slice(t, i + 1, i + 3), ' '))) ELSE [] END AS s FROM {prefix}toks),
{prefix}hashes AS (SELECT node, CAST(('0x' || substr(md5(shingle), 1, 8)) AS BIGINT) AS hv
           FROM (SELECT node, unnest(s) AS shingle FROM {prefix}shingled)),
{prefix}sigs AS (SELECT d.node, {mins} FROM (SELECT {id_col} AS node FROM {table}) d
         LEFT JOIN {prefix}hashes h ON d.node = h.node GROUP BY d.node),
{prefix}bands AS ({band_sel})"""


def shingle_set_ctes(table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """``sets`` (node, s, n): sorted distinct word triples; ``classes``: documents of one set."""
    return f"""
set_toks AS (SELECT {id_col} AS node, regexp_extract_all(lower({text_col}), '{NON_WS}+') AS t FROM {table}),
sets AS MATERIALIZED (
  SELECT node, s, len(s) AS n FROM (
    SELECT node, CASE WHEN len(t) >= 3 THEN list_sort(list_distinct([t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] FOR i IN range(1, len(t) - 1)])) ELSE [] END AS s
    FROM set_toks)),
classes AS MATERIALIZED (
  SELECT node, CASE WHEN n = 0 THEN node ELSE min(node) OVER (PARTITION BY s) END AS class_id,
         CASE WHEN n = 0 THEN 1 ELSE count(*) OVER (PARTITION BY s) END AS class_size, n FROM sets)"""


def link_ctes(percent: int) -> str:
    """``links`` between classes, by joining all their shingles."""
    return f""",
class_shingles AS MATERIALIZED (SELECT s.node, s.n, unnest(s.s) AS g FROM sets s JOIN classes c ON c.node = s.node AND c.class_id = s.node),
common_shingles AS (
  SELECT a.node AS class_id, b.node AS partner_id, a.n AS n_class, b.n AS n_partner, count(*) AS shared
  FROM class_shingles a JOIN class_shingles b ON b.g = a.g AND a.node < b.node GROUP BY ALL),
links AS (SELECT * FROM common_shingles WHERE 100 * shared >= {percent} * (n_class + n_partner - shared))"""


def greedy_ctes(members: str) -> str:
    """Sequential greedy acceptance over ``members`` (grp, node, band_key), a
    step for each node in order; ``pre`` (grp, band_key) is indexed from the
    start.  Ends in ``verdict`` (grp, node, accepted)."""
    return f"""
keyed AS (SELECT grp, node, list(DISTINCT band_key) AS ks FROM {members} GROUP BY grp, node),
steps AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY node) AS rn FROM keyed),
known AS (SELECT grp, list(DISTINCT band_key) AS ks FROM pre GROUP BY grp),
walk AS (
  SELECT s.grp, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS node, coalesce(any_value(k.ks), CAST([] AS VARCHAR[])) AS taken, FALSE AS accepted
  FROM steps s LEFT JOIN known k ON k.grp = s.grp GROUP BY s.grp
  UNION ALL
  SELECT s.grp, s.rn, s.node, CASE WHEN list_has_any(w.taken, s.ks) THEN w.taken ELSE list_concat(w.taken, s.ks) END,
         NOT list_has_any(w.taken, s.ks)
  FROM walk w JOIN steps s ON s.grp = w.grp AND s.rn = w.rn + 1),
verdict AS (SELECT grp, node, accepted FROM walk WHERE rn > 0)"""


# ------------------------------------------------------------ registry ---

def fingerprint_cte(name: str, src: str) -> str:
    """Shard fingerprints over the bucket rows of ``src`` (a corpus CTE)."""
    d = "md5(concat_ws(chr(31), prompt, completion))"
    words = ", ".join(f"CAST(('0x' || substr({d}, {8 * i + 1}, 8)) AS BIGINT) AS w{i}" for i in range(4))
    sums = ", ".join(f"sum(w{i}) AS s{i}" for i in range(4))
    fp = "md5(concat_ws(':', CAST(n_rows AS VARCHAR), " + ", ".join(
        f"CAST(s{i} AS VARCHAR)" for i in range(4)) + "))"
    return f""",
{name}_rows AS (SELECT * EXCLUDE (buckets), unnest(buckets) AS bucket
                FROM (SELECT *, {bucket_list()} AS buckets FROM {src}) WHERE len(buckets) > 0),
{name}_words AS (SELECT bucket, {words} FROM (
    SELECT bucket, {prompt_sql()} AS prompt, coalesce(utterance, '') AS completion FROM {name}_rows)),
{name}_agg AS (SELECT bucket, count(*) AS n_rows, {sums} FROM {name}_words GROUP BY bucket),
{name} AS (SELECT bucket, bucket || '.jsonl' AS file_name, n_rows, {fp} AS hash FROM {name}_agg)"""


def registry_cte() -> str:
    statuses = ", ".join(lit(s) for s in ["completed", "failed", "cancelled", "running"])
    job = "'ft-' || substr(md5('job|' || hash), 1, 8) || '-' || substr(md5('job|' || hash), 9, 4)"
    changed = f"{hash32('changed', 'bucket')} % 5 = 0"
    return f""",
before_fp AS (SELECT * FROM current_fp WHERE NOT ({changed}) UNION ALL SELECT * FROM previous_fp WHERE {changed}),
registry AS (
  SELECT hash, {job} AS job_id, file_name, bucket AS trait,
         {d(1.75e9)} + CAST({hash32('created', 'hash')} % 100000 AS DOUBLE) AS created_at,
         list_value({statuses})[{hash32('status', 'hash')} % 4 + 1] AS status
  FROM before_fp)"""


def plan_cte() -> str:
    return """,
plan AS (
  SELECT c.bucket, c.file_name, c.n_rows, c.hash,
         CASE WHEN r.status IS NULL THEN 'launch' WHEN r.status = 'completed' THEN 'skip_completed'
              WHEN r.status IN ('failed', 'cancelled') THEN 'retry_failed' ELSE 'in_progress' END AS action,
         r.job_id AS known_job
  FROM current_fp c LEFT JOIN registry r ON c.hash = r.hash)"""


# -------------------------------------------------------------- vectors ---

def strict_vector_sql(name: str, traits) -> list[str]:
    out = []
    for t in traits:
        p, m = lit(f"{t}_plus"), lit(f"{t}_minus")
        out.append(f"CASE WHEN starts_with({name}, {p}) OR ends_with({name}, {p}) THEN {d(1)} "
                   f"WHEN starts_with({name}, {m}) OR ends_with({name}, {m}) THEN {d(-1)} ELSE {d(0)} END")
    return out


def lenient_vector_sql(name: str, traits) -> tuple[list[str], str]:
    low = f"lower({name})"
    base = []
    for t in traits:
        base.append(
            f"CASE WHEN contains({low}, {lit(t + '_plus')}) OR contains({low}, {lit(t + '+')}) THEN {d(1)} "
            f"WHEN contains({low}, {lit(t + '_minus')}) OR contains({low}, {lit(t + '-')}) THEN {d(-1)} "
            f"WHEN contains({low}, {lit(t)}) THEN {d(C.LENIENT_MENTION_SCORE)} ELSE {d(0)} END")
    fallback = "(" + " AND ".join(f"({b}) = 0" for b in base) + ")"
    slot = f"({hash32('slot', name)} % {len(traits)})"
    vec = [f"CASE WHEN {fallback} AND {slot} = {i} THEN {d(C.LENIENT_FALLBACK_SCORE)} ELSE {b} END"
           for i, b in enumerate(base)]
    return vec, fallback


def dbl_list(x: str) -> str:
    return f"list_transform({x}, lambda v: CAST(v AS DOUBLE))"


def cosine_sql(a: str, b: str) -> str:
    dot = f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
    na = f"list_sum(list_transform({a}, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))"
    nb = f"list_sum(list_transform({b}, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))"
    den = f"(sqrt({na}) * sqrt({nb}))"
    return f"CASE WHEN len({a}) = len({b}) AND {den} > 0 THEN {dot} / {den} END"


def tensors_cte() -> str:
    return """
tensors AS (
  SELECT 'adapter_' || CAST(vec_id // 8 AS VARCHAR) AS adapter,
         'layers.' || CAST((vec_id % 8) // 2 AS VARCHAR) || '.lora_' || CASE WHEN vec_id % 2 = 0 THEN 'A' ELSE 'B' END
           AS tensor_key,
         CAST(unnest(range(0, len(embedding))) AS BIGINT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value
  FROM embeddings),
layout0 AS (SELECT tensor_key, count(*) AS numel FROM tensors WHERE adapter = 'adapter_0' GROUP BY tensor_key),
layout AS (SELECT tensor_key, numel,
                  CAST(coalesce(sum(numel) OVER (ORDER BY tensor_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                       AS BIGINT) AS "offset" FROM layout0)"""
