"""DuckDB oracle SQL for every registered query that SQL can express."""

from __future__ import annotations

from ..functions import constants as C
from . import sqlbase as B

SQL: dict[str, str] = {}
BASE = B.classified_ctes()
SAMPLED = BASE + B.sampled_cte("m1")


def _w(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def _cols_of_classified() -> str:
    return B.CORPUS_COLS + ", label, reason"


for _key, _cte in [("label_roles", "src_roles"), ("label_dialogue_arrays", "src_dialogue"),
                   ("label_int", "src_int"), ("label_string", "src_string"),
                   ("label_activations", "src_act")]:
    SQL[_key] = _w(BASE, f"SELECT {_cols_of_classified()} FROM {_cte}")

SQL["role_first_speaker"] = _w(BASE, "SELECT conv_id, emotional_speaker FROM first_speakers")

SQL["skip_funnel"] = _w(BASE, """
SELECT source, coalesce(reason, 'processed') AS reason, count(*) AS n
FROM classified GROUP BY 1, 2""")

SQL["corpus_union"] = _w(BASE, f"SELECT {B.CORPUS_COLS} FROM corpus_raw")
SQL["corpus_sampled"] = _w(SAMPLED, f"SELECT {B.CORPUS_COLS} FROM corpus")

SQL["sampling_reduction"] = _w(SAMPLED, """
SELECT b.total_before, a.total_after, b.total_before - a.total_after AS reduction,
       round(CASE WHEN b.total_before > 0
                  THEN CAST(b.total_before - a.total_after AS DOUBLE) * 100.0 / b.total_before END, 6)
         AS reduction_pct
FROM (SELECT count(*) AS total_before FROM corpus_raw) b, (SELECT count(*) AS total_after FROM corpus) a""")

_strata = " OR ".join(f"(source = {B.lit(s)} AND original_tag = {B.lit(t)})"
                      for s, t, _ in C.SAMPLING_STRATA if t is not None)
SQL["sampling_strata_counts"] = _w(SAMPLED, f"""
SELECT source, original_tag, count(*) AS n, 'before' AS stage FROM corpus_raw WHERE {_strata} GROUP BY 1, 2
UNION ALL
SELECT source, original_tag, count(*) AS n, 'after' AS stage FROM corpus WHERE {_strata} GROUP BY 1, 2""")

SQL["source_distribution"] = _w(SAMPLED, """
SELECT source, count(*) AS n, 'before' AS stage FROM corpus_raw GROUP BY 1
UNION ALL SELECT source, count(*) AS n, 'after' AS stage FROM corpus GROUP BY 1""")

SQL["source_stats"] = _w(SAMPLED, """
SELECT source, count(*) AS sample_count, round(avg(utterance_length), 6) AS avg_length,
       min(utterance_length) AS min_length, max(utterance_length) AS max_length,
       round(avg(word_count), 6) AS avg_words, count(DISTINCT original_tag) AS unique_tags,
       count(DISTINCT origin_id) AS unique_origins
FROM corpus GROUP BY source""")

_unpivot = " UNION ALL ".join(
    f"SELECT source, {B.lit(t)} AS trait, trait_{t} AS value FROM corpus" for t in C.TRAITS)
SQL["trait_polarity"] = _w(SAMPLED, f""",
long_traits AS ({_unpivot})
SELECT trait, source, count(CASE WHEN value > 0 THEN 1 END) AS positive,
       count(CASE WHEN value < 0 THEN 1 END) AS negative, count(CASE WHEN value = 0 THEN 1 END) AS neutral,
       round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value
FROM long_traits GROUP BY trait, source""")

SQL["top_tags"] = _w(SAMPLED, """,
tag_counts AS (SELECT source, original_tag, count(*) AS n FROM corpus GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, original_tag ASC NULLS FIRST) AS rank
           FROM tag_counts)
SELECT source, original_tag, n, rank FROM ranked WHERE rank <= %d""" % C.TOP_TAGS)

_zero = " AND ".join(f"{c} = 0" for c in C.TRAIT_COLUMNS)
SQL["quality_issues"] = _w(SAMPLED, f"""
SELECT source, count(*) AS total,
       count(*) FILTER (WHERE utterance_length < {C.SHORT_UTTERANCE_CHARS}) AS short_utterances,
       count(*) FILTER (WHERE utterance_length > {C.LONG_UTTERANCE_CHARS}) AS long_utterances,
       count(*) FILTER (WHERE {_zero}) AS all_zero_traits
FROM corpus GROUP BY source""")

SQL["label_frequency"] = _w(BASE, """
SELECT source, label, count(*) AS n FROM classified WHERE label IS NOT NULL GROUP BY 1, 2""")

SQL["unmapped_labels"] = _w(BASE, """
SELECT source, label, count(*) AS n FROM classified WHERE reason = 'unmapped' GROUP BY 1, 2""")

SQL["utterance_quality"] = f"""
SELECT doc_id, CAST(length(text) AS BIGINT) AS utterance_length, {B.word_count('text')} AS word_count,
       coalesce({B.meaningful('text')}, 'meaningful') AS reason
FROM documents"""

_PH = "alpha bravo charlie delta echo foxtrot golf hotel india juliet "
SQL["quality_edges"] = f"""
WITH edges AS (
  SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN text WHEN 1 THEN 'this has CONV: id ' || substr(text, 1, 50)
         WHEN 2 THEN repeat('{_PH}', 4) || substr(text, 1, 40) WHEN 3 THEN 'ok fine' WHEN 4 THEN 'sad'
         WHEN 5 THEN '   .  !  ?  ,  x   ' WHEN 6 THEN substr(text, 1, 1500) WHEN 7 THEN 'I love it' END AS text
  FROM documents)
SELECT doc_id, coalesce({B.meaningful('text')}, 'meaningful') AS reason FROM edges"""

SQL["origin_counts"] = _w(BASE, """
SELECT source, count(*) AS processed, count(DISTINCT origin_id) AS unique_origins FROM corpus_raw GROUP BY 1""")

SEEDS = B.seed_ctes()
SQL["seed_quality"] = _w(SEEDS, """
SELECT conv_id, turn, emotion, cleaned, target_emotion, seed_reason, reason FROM seed_funnel""")
SQL["seed_skip_reasons"] = _w(SEEDS, "SELECT reason, count(*) AS n FROM seed_funnel WHERE target_emotion GROUP BY 1")
SQL["seed_emotions"] = _w(SEEDS, "SELECT emotion, count(*) AS n FROM seed_funnel GROUP BY 1")
SQL["seed_top_n"] = _w(SEEDS, "SELECT utterance, source, emotion, origin_id, word_count FROM seed_top")

_EDGE_SEEDS = [
    "hello", "one two three four five six seven", "I think the train leaves at nine tomorrow",
    "He put the box on the shelf today", "He put the box on the shelf today.",
    "Why would they paint the kitchen green again?", " ".join(["word"] * 31), "!!! ??? ...", ""]
_edge = "CASE (conv_id * 3 + turn) % 10 WHEN 0 THEN text " + " ".join(
    f"WHEN {i} THEN {B.lit(x)}" for i, x in enumerate(_EDGE_SEEDS, 1)) + " END"
SQL["seed_edges"] = f"""
WITH edges AS (SELECT conv_id, turn, {_edge} AS text FROM conversations),
cleaned AS (SELECT conv_id, turn, {B.clean_seed('text')} AS cleaned FROM edges)
SELECT conv_id, turn, cleaned,
       CASE WHEN cleaned IS NULL THEN 'cleaning_failed' ELSE {B.seed_reason('cleaned', 1)} END AS seed_reason
FROM cleaned"""
SQL["seed_file_scan"] = _w(SEEDS, "SELECT seed FROM seed_pool UNION ALL SELECT seed FROM seed_pool")
SQL["label_dialogue_lists"] = _w(B.dialogue_list_ctes(), f"SELECT {_cols_of_classified()} FROM src_lists")
SQL["corpus_export_roundtrip"] = _w(SAMPLED, f"SELECT utterance, {B.TRAIT_COLS}, source, origin_id, original_tag FROM corpus")

SQL["corpus_json_array"] = SQL["corpus_export_roundtrip"]
SQL["corpus_file_roundtrips"] = _w(SAMPLED, f"SELECT {B.CORPUS_COLS}, unnest(['parquet', 'csv']) AS format FROM corpus")
SQL["split_rows"] = "SELECT conv_id, turn, role, text, 'validation' AS split FROM conversations WHERE conv_id % 10 = 8"

BUCKETS = SAMPLED + B.bucket_ctes()
SQL["bucket_rows"] = _w(BUCKETS, f"SELECT bucket, source, origin_id, {B.TRAIT_COLS} FROM bucket_rows")
SQL["bucket_sizes"] = _w(BUCKETS, f"""
SELECT bucket, count(*) AS n, count(*) >= {C.MIN_PER_BUCKET} AS kept FROM bucket_rows GROUP BY bucket""")
SQL["prompt_rows"] = _w(SAMPLED, f"""
SELECT source, origin_id, {B.prompt_sql()} AS prompt, coalesce(utterance, '') AS completion FROM corpus""")
SQL["converted_counts"] = _w(BUCKETS, "SELECT bucket, count(*) AS n FROM bucket_rows GROUP BY ROLLUP (bucket)")
SQL["bucket_needs"] = _w(BUCKETS, "SELECT bucket, existing, need FROM bucket_needs")

SQL["refill_rounds"] = _w(BUCKETS, "SELECT bucket, greatest(existing, 200)::BIGINT AS existing, 0::BIGINT AS need FROM bucket_needs")

_h = B.hash32
_REQUESTS = f""",
numbered AS (SELECT seed, row_number() OVER (ORDER BY {_h('pool', 'seed')}, seed) - 1 AS seed_no FROM seed_pool),
pool_size AS (SELECT count(*) AS pool_size FROM numbered),
req AS (
  SELECT n.bucket, n.description, n.templates, n.need, CAST(unnest(range(0, n.need * {C.OVERSAMPLE_FACTOR})) AS BIGINT) AS k
  FROM bucket_needs n WHERE n.need > 0),
picked AS (
  SELECT r.*, p.pool_size,
         CASE WHEN p.pool_size >= r.need * {C.OVERSAMPLE_FACTOR}
              THEN ({_h('offset', 'r.bucket')} % p.pool_size + r.k) % p.pool_size
              ELSE {_h('pick', 'r.bucket', 'CAST(r.k AS VARCHAR)')} % p.pool_size END AS seed_no
  FROM req r, pool_size p WHERE p.pool_size > 0)
SELECT x.bucket, x.k AS request_no, s.seed,
       x.templates[{_h('tmpl', 'x.bucket', 'CAST(x.k AS VARCHAR)')} % 4 + 1] || {B.lit(C.STYLE_JOIN)} || x.description
         AS system_prompt
FROM picked x JOIN numbered s ON x.seed_no = s.seed_no"""
SQL["paraphrase_requests"] = _w(BUCKETS + "," + SEEDS, _REQUESTS)
SQL["paraphrase_requests_few"] = _w(SAMPLED + B.bucket_ctes(10) + "," + SEEDS, _REQUESTS)

MINHASH = B.minhash_ctes()
SQL["minhash_bands"] = _w(MINHASH, "SELECT node AS doc_id, band, band_key FROM bands")
SQL["near_dup_first"] = _w(MINHASH, """,
band_min AS (SELECT band_key, min(node) AS band_min FROM bands GROUP BY band_key)
SELECT b.node AS doc_id, coalesce(min(CASE WHEN m.band_min < b.node THEN m.band_min END), -1) AS earliest_partner
FROM bands b JOIN band_min m ON b.band_key = m.band_key GROUP BY b.node""")

_SETS = B.shingle_set_ctes()
_LINKS = _SETS + B.link_ctes(85)
SQL["near_dup_classes"] = _w(_SETS, "SELECT node AS doc_id, class_id, class_size, n AS n_shingles FROM classes")
SQL["near_dup_links"] = _w(_LINKS, "SELECT class_id, partner_id, n_class, n_partner, shared FROM links")
_CHECKED = """,
band_least AS (SELECT band_key, min(node) AS partner FROM bands GROUP BY band_key),
cand AS (SELECT b.node, m.partner, count(*) AS bands FROM bands b JOIN band_least m ON m.band_key = b.band_key AND m.partner < b.node GROUP BY ALL),
checked AS (
  SELECT c.*, CAST(len(list_intersect(p.s, q.s)) AS BIGINT) AS shared, p.n + q.n - len(list_intersect(p.s, q.s)) AS union_size
  FROM cand c JOIN sets p ON p.node = c.node JOIN sets q ON q.node = c.partner),
judged AS (SELECT node, partner, bands, shared, CAST(union_size AS BIGINT) AS union_size, union_size > 0 AND 100 * shared >= 85 * union_size AS verified FROM checked)"""
_ALL_CHECKED = _CHECKED.replace("band_least AS (SELECT band_key, min(node) AS partner FROM bands GROUP BY band_key)", "band_least AS (SELECT DISTINCT band_key, node AS partner FROM bands)")
SQL["near_dup_verified"] = _w(_SETS + "," + MINHASH, _ALL_CHECKED + "\nSELECT node AS doc_id, partner, bands, shared, union_size, verified FROM judged")
SQL["lsh_quality"] = _w(_LINKS + "," + MINHASH, _CHECKED + """,
met AS (SELECT DISTINCT l.class_id, l.partner_id FROM links l JOIN bands a ON a.node = l.class_id JOIN bands b ON b.node = l.partner_id AND b.band_key = a.band_key),
c AS (SELECT count(*) AS candidates, count(*) FILTER (WHERE verified) AS true_candidates FROM judged),
e AS (SELECT (SELECT count(*) FROM links) AS exact_links, (SELECT count(*) FROM met) AS found_links)
SELECT candidates, true_candidates, candidates - true_candidates AS false_positives, exact_links, found_links,
       round(CASE WHEN exact_links = 0 THEN 1.0 ELSE found_links::DOUBLE / exact_links END, 6) AS recall
FROM c, e""")

_SHARED = """,
shared_bands AS (SELECT grp, band_key FROM members GROUP BY grp, band_key HAVING count(*) > 1),
chosen AS (SELECT DISTINCT m.grp, m.node, m.band_key FROM members m SEMI JOIN shared_bands s ON s.grp = m.grp AND s.band_key = m.band_key),"""
SQL["greedy_dedup"] = "WITH RECURSIVE " + MINHASH + """,
members AS (SELECT 0 AS grp, node, band_key FROM bands), pre AS (SELECT 0 AS grp, 'x' AS band_key WHERE FALSE)""" \
    + _SHARED + B.greedy_ctes("chosen") + """
SELECT d.doc_id, coalesce(v.accepted, TRUE) AS accepted FROM documents d LEFT JOIN verdict v ON v.node = d.doc_id"""

_bucket_of = "list_value(" + ", ".join(B.lit(b) for b in C.BUCKETS) + f")[doc_id % {len(C.BUCKETS)} + 1]"
_traits = ", ".join(
    f"CASE WHEN starts_with(b, '{t}_plus') THEN {B.d(1)} WHEN starts_with(b, '{t}_minus') THEN {B.d(-1)} ELSE {B.d(0)} END AS trait_{t}"
    for t in C.TRAITS)


def _fill(pre: str, needs: str) -> str:
    """Accepted responses per bucket, in order, up to the need, as synthetic rows."""
    return f""",
members AS (SELECT {_bucket_of.replace('doc_id', 'node')} AS grp, node, band_key FROM bands),
pre AS ({pre})""" + _SHARED.replace("HAVING count(*) > 1", "HAVING count(*) > 1 UNION SELECT grp, band_key FROM pre") \
        + B.greedy_ctes("chosen") + f""",
responses AS (SELECT doc_id, text, {_bucket_of} AS b, 'seed ' || CAST(doc_id AS VARCHAR) AS seed FROM documents),
ranked AS (
  SELECT r.*, row_number() OVER (PARTITION BY b ORDER BY doc_id) AS rank
  FROM responses r LEFT JOIN verdict v ON v.node = r.doc_id WHERE coalesce(v.accepted, TRUE))
SELECT text AS utterance, {_traits}, {B.lit(C.SYNTHETIC_SOURCE)} AS source,
       sha256(concat_ws('|', b, text, seed)) AS origin_id, b AS original_tag, seed AS original_seed, b AS bucket
FROM ranked r JOIN ({needs}) n ON n.bucket = r.b WHERE r.rank <= n.need"""


_ROWS = ",\nshard_rows AS (SELECT *, row_number() OVER () AS rid FROM bucket_rows),"
SQL["fill_to_target"] = "WITH RECURSIVE " + BUCKETS + _ROWS + B.minhash_ctes("shard_rows", "rid", "utterance", "old_") + "," + MINHASH \
    + _fill("SELECT DISTINCT s.bucket AS grp, o.band_key FROM old_bands o JOIN shard_rows s ON s.rid = o.node",
            "SELECT bucket, need FROM bucket_needs")
SQL["fill_stream"] = "WITH RECURSIVE " + MINHASH + _fill(
    "SELECT '' AS grp, '' AS band_key WHERE FALSE",
    f"SELECT unnest(list_value({', '.join(B.lit(b) for b in C.BUCKETS)})) AS bucket, {C.TARGET_PER_BUCKET} AS need")

# ------------------------------------------------------------ registry ---
FP_CURRENT = SAMPLED + B.fingerprint_cte("current_fp", "corpus")
SQL["shard_fingerprints"] = _w(FP_CURRENT, "SELECT bucket, file_name, n_rows, hash FROM current_fp")
PLAN = FP_CURRENT + B.fingerprint_cte("previous_fp", "corpus_raw") + B.registry_cte() + B.plan_cte()
SQL["run_plan"] = _w(PLAN, """
SELECT bucket, file_name, n_rows, hash, action,
       CASE WHEN action IN ('skip_completed', 'in_progress') THEN known_job END AS job_id FROM plan""")
_now = 1.76e9
_newjob = f"md5('job@{_now}|' || hash)"
SQL["registry_upsert"] = _w(PLAN, f""",
relaunch AS (SELECT * FROM plan WHERE action IN ('launch', 'retry_failed')),
merged AS (
  SELECT hash, job_id, file_name, trait, created_at FROM registry WHERE hash NOT IN (SELECT hash FROM relaunch)
  UNION ALL
  SELECT hash, 'ft-' || substr({_newjob}, 1, 8) || '-' || substr({_newjob}, 9, 4) AS job_id, file_name,
         bucket AS trait, {B.d(_now)} AS created_at FROM relaunch),
ranked AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY created_at DESC, job_id DESC) AS rn FROM merged)
SELECT hash, job_id, file_name, trait, created_at FROM ranked WHERE rn = 1""")

from ..operators.registry import EVENT_STATUS  # noqa: E402
_ev = "CASE " + " ".join(f"WHEN event_type = {B.lit(k)} THEN {B.lit(v)}" for k, v in EVENT_STATUS.items()) \
    + " ELSE 'cancelled' END"
SQL["job_terminal_status"] = f"""
WITH log AS (SELECT 'ft-' || CAST(user_id AS VARCHAR) AS job_id, ts, event_id, {_ev} AS status FROM events),
latest AS (SELECT job_id, count(*) AS n_events, arg_max(status, (ts, event_id)) AS last_status FROM log GROUP BY job_id)
SELECT job_id, n_events, last_status,
       CASE WHEN last_status = 'completed' THEN 'completed' WHEN last_status IN ('failed', 'cancelled') THEN 'failed'
            ELSE 'remaining' END AS outcome
FROM latest"""

SQL["job_status_stream"] = SQL["job_terminal_status"]
SQL["registry_versions"] = SQL["registry_upsert"].replace(
    "SELECT hash, job_id, file_name, trait, created_at FROM ranked WHERE rn = 1",
    "SELECT hash, job_id, file_name, trait, created_at, 2 AS version FROM ranked WHERE rn = 1 "
    "UNION ALL SELECT hash, job_id, file_name, trait, created_at, 1 AS version FROM registry")

_req = ", ".join(f"({B.lit(f'{t}_{p}')})" for t in C.PLANNER_TRAITS for p in ("plus", "minus"))
SQL["coverage_audit"] = _w(BUCKETS, f""",
requested AS (SELECT * FROM (VALUES {_req}) AS t(bucket)),
available AS (SELECT bucket, count(*) AS n_rows FROM bucket_rows GROUP BY bucket),
audit AS (
  SELECT r.bucket, TRUE AS requested, a.n_rows IS NOT NULL AS available, CAST(coalesce(a.n_rows, 0) AS BIGINT) AS n_rows
  FROM requested r LEFT JOIN available a ON r.bucket = a.bucket
  UNION ALL
  SELECT a.bucket, FALSE, TRUE, CAST(a.n_rows AS BIGINT) FROM available a
  WHERE a.bucket NOT IN (SELECT bucket FROM requested))
SELECT *, CASE WHEN requested AND available THEN 'ready' WHEN requested THEN 'missing' ELSE 'unrequested' END AS status
FROM audit""")

# ------------------------------------------------------------- vectors ---
_names = BUCKETS + ",\nnames AS (SELECT DISTINCT bucket AS name FROM bucket_rows)"
_sv = B.strict_vector_sql("name", C.PLANNER_TRAITS)
SQL["trait_vectors"] = _w(_names, f""",
vt AS (SELECT name, 'lora_checkpoints/' || replace(name, chr(92), '/') || '.safetensors' AS file_path,
       {', '.join(f'{v} AS v{i}' for i, v in enumerate(_sv))} FROM names)
SELECT *, {' AND '.join(f'v{i} = 0' for i in range(len(_sv)))} AS zero_vector FROM vt""")
_lv, _fb = B.lenient_vector_sql("name", C.LENIENT_TRAITS)
_lenient = f""",
lt AS (SELECT name, {', '.join(f'{v} AS v{i}' for i, v in enumerate(_lv))}, {_fb} AS fallback FROM names)"""
SQL["trait_vectors_lenient"] = _w(_names, _lenient + "\nSELECT * FROM lt")
_vc = ", ".join(f"v{i}" for i in range(len(_lv)))
SQL["trait_vector_audit"] = _w(_names, _lenient + f""",
g AS (SELECT {_vc}, count(*) AS n_sharing, min(name) AS first_name FROM lt GROUP BY {_vc})
SELECT lt.name, g.first_name, g.n_sharing, g.n_sharing > 1 AS shared,
       {' AND '.join(f'lt.v{i} = 0' for i in range(len(_lv)))} AS zero_vector, lt.fallback
FROM lt JOIN g USING ({_vc})""")

_dv = B.dbl_list("embedding")
_STATS = f"""
s0 AS (SELECT vec_id, {_dv} AS v, len(embedding) AS n FROM embeddings WHERE len(embedding) > 0),
s1 AS (SELECT *, list_sum(v) / n AS mean FROM s0),
s2 AS (SELECT *, list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) / n AS var FROM s1),
stats AS (
  SELECT vec_id, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(var, 6) AS variance, round(sqrt(var), 6) AS std,
         list_min(list_filter(v, lambda x: isfinite(x))) AS "min", list_max(list_filter(v, lambda x: isfinite(x))) AS "max",
         CAST(len(list_filter(v, lambda x: abs(x) < 1e-10)) AS BIGINT) AS zeros,
         CAST(len(list_filter(v, lambda x: NOT isfinite(x))) AS BIGINT) AS non_finite
  FROM s2)"""
SQL["vector_stats"] = _w(_STATS, "SELECT * FROM stats")
SQL["vector_validity"] = _w(_STATS, """
SELECT count(*) AS n_vectors, count(DISTINCT n) AS n_dims, arg_min(n, vec_id) AS first_dim,
       bool_and(non_finite = 0) AS all_finite, bool_and(variance > 0) AS all_vary,
       count(DISTINCT n) = 1 AS consistent_dims,
       count(*) = (SELECT count(*) FROM embeddings) AS all_processed
FROM stats""")
SQL["vector_dup_copies"] = f"""
SELECT min(vec_id) AS first_id, count(*) AS n_vectors, count(*) - 1 AS duplicates
FROM (SELECT vec_id, embedding FROM embeddings
      UNION ALL SELECT vec_id + 1000000000, embedding FROM embeddings WHERE vec_id % 10 = 0)
GROUP BY list_slice(embedding, 1, {C.SIGNATURE_VALUES})"""
SQL["artifact_audit"] = """
WITH a AS (SELECT vec_id // 1024 AS artifact, count(*) AS n FROM embeddings GROUP BY 1),
b AS (SELECT artifact, length('{"part":' || artifact || ',"n":' || n || '}') AS len FROM a)
SELECT artifact, CAST(len + 9 AS BIGINT) AS size, CAST(CASE WHEN artifact % 5 = 0 THEN 120 ELSE len END AS BIGINT) AS header_len,
       artifact % 5 = 0 AND 120 > len + 9 AS corrupt
FROM b"""
SQL["vector_dup_signature"] = f"""
SELECT min(vec_id) AS first_id, count(*) AS n_vectors, count(*) - 1 AS duplicates
FROM embeddings GROUP BY list_slice(embedding, 1, {C.SIGNATURE_VALUES})"""
SQL["cosine_triplets"] = f"""
WITH j AS (SELECT a.vec_id AS anchor, a.embedding AS a, b.embedding AS b, c.embedding AS c
           FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2),
r AS (SELECT anchor, round({B.cosine_sql('a', 'b')}, 6) AS cos_near, round({B.cosine_sql('a', 'c')}, 6) AS cos_far FROM j)
SELECT anchor, cos_near, cos_far, coalesce(cos_near > cos_far, FALSE) AS order_holds FROM r"""
SQL["vector_global"] = """
WITH x AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT count(*) AS n_values, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS "min", max(x) AS "max"
FROM x"""
SQL["vector_fit"] = f"""
SELECT vec_id, CAST({C.VECTOR_DIM} AS BIGINT) AS fitted_dim, CAST(greatest({C.VECTOR_DIM} - len(embedding), 0) AS BIGINT)
       AS padded,
       round(sqrt(list_sum(list_transform(list_slice(embedding, 1, {C.VECTOR_DIM}),
             lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS l2
FROM embeddings"""

_T = B.tensors_cte()
SQL["adapter_flat_values"] = _w(_T, """
SELECT t.adapter, t.tensor_key, l."offset" + t.pos AS flat_pos, t.value FROM tensors t JOIN layout l USING (tensor_key)""")
SQL["adapter_flatten"] = _w(_T, """,
expected AS (SELECT sum(numel) AS expected, count(*) AS expected_tensors FROM layout),
summary AS (SELECT adapter, count(DISTINCT tensor_key) AS n_tensors, count(*) AS n_values FROM tensors GROUP BY adapter)
SELECT s.adapter, s.n_tensors, s.n_values, CAST(e.expected AS BIGINT) AS expected, e.expected_tensors,
       s.n_values = e.expected AND s.n_tensors = e.expected_tensors AS length_ok
FROM summary s, expected e""")
SQL["adapter_json_ingest"] = _w(_T, "SELECT adapter, tensor_key, pos, value, 'float32' AS dtype FROM tensors")
SQL["vector_norms"] = _w(_T, """,
sq AS (SELECT adapter, round(sum(CASE WHEN ends_with(tensor_key, 'lora_A') THEN value * value END), 6) AS sumsq_a,
              round(sum(CASE WHEN ends_with(tensor_key, 'lora_B') THEN value * value END), 6) AS sumsq_b
       FROM tensors GROUP BY adapter),
ref AS (SELECT tensor_key, pos, value AS ref_value FROM tensors WHERE adapter = 'adapter_0'),
diff AS (SELECT t.adapter, round(avg(abs(t.value - r.ref_value)), 6) AS mean_abs_diff_to_ref
         FROM tensors t JOIN ref r USING (tensor_key, pos) GROUP BY t.adapter)
SELECT sq.*, diff.mean_abs_diff_to_ref FROM sq LEFT JOIN diff USING (adapter)""")
SQL["vector_blend"] = _w(_T, f"""
SELECT tensor_key, pos, round(sum({B.d(C.ADAPTER_BLEND_WEIGHT)} * value), 6) AS value, count(*) AS n_adapters
FROM tensors GROUP BY tensor_key, pos""")

_HALF = """
raw AS (
  SELECT vec_id // 8 AS a, vec_id % 8 AS k, CAST(unnest(range(0, len(embedding))) AS BIGINT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x, len(embedding) AS n
  FROM embeddings),
vals AS (
  SELECT 'adapter_' || a AS adapter, 't' || k AS tensor_key, pos, a % 7 = 0 AND k = 4 AS wrong,
         CASE WHEN k IN (2, 3) THEN 'float16' WHEN k IN (4, 5) THEN 'bfloat16' ELSE 'float32' END AS dtype,
         CASE WHEN pos = 61 THEN x * 1e-39 WHEN pos = 62 THEN sign(x) * 3.4e38 WHEN pos % 5 = 1 THEN x * 1e-6 WHEN pos % 5 = 2 THEN x * 1e6
              WHEN pos % 5 = 3 THEN 1 + (floor(abs(x) * 4096) % 1024 + 0.5) / 1024 WHEN pos % 5 = 4 THEN 1 + (floor(abs(x) * 4096) % 128 + 0.5) / 128 ELSE x END AS v
  FROM raw WHERE NOT (k = 6 AND pos >= n // 2 * 2)),
singles AS (SELECT *, CASE WHEN abs(v) < 3.4028235677973366e38 THEN CAST(CAST(v AS FLOAT) AS DOUBLE) ELSE sign(v) * 'inf'::DOUBLE END AS s,
                   CASE dtype WHEN 'float16' THEN 10 ELSE 7 END AS digits, CASE dtype WHEN 'float16' THEN -14 ELSE -126 END AS least,
                   CASE dtype WHEN 'float16' THEN 65504.0::DOUBLE ELSE 3.3895313892515355e38 END AS most FROM vals),
exps AS (SELECT *, CASE WHEN s = 0 THEN least ELSE CAST(floor(log2(abs(s))) AS INT) END AS e0 FROM singles),
quanta AS (SELECT *, pow(2.0::DOUBLE, greatest(CASE WHEN s <> 0 AND pow(2.0::DOUBLE, e0) > abs(s) THEN e0 - 1 WHEN s <> 0 AND pow(2.0::DOUBLE, e0 + 1) <= abs(s) THEN e0 + 1 ELSE e0 END, least) - digits) AS q
           FROM exps),
halves AS (SELECT *, abs(s) / q - floor(abs(s) / q) AS part, floor(abs(s) / q) AS whole FROM quanta),
near AS (SELECT *, CASE WHEN dtype = 'float32' THEN v ELSE sign(s) * q * (whole + CASE WHEN part > 0.5 OR (part = 0.5 AND whole % 2 = 1) THEN 1 ELSE 0 END) END AS r FROM halves)"""
SQL["adapter_half_ingest"] = _w(_HALF, """
SELECT adapter, tensor_key, pos, dtype, CASE WHEN dtype = 'float32' OR abs(r) <= most THEN r END AS value,
       CAST(CASE WHEN dtype <> 'float32' AND abs(r) > most THEN sign(r) ELSE 0 END AS INT) AS infinite
FROM near WHERE NOT wrong""")
SQL["adapter_tensor_audit"] = """
SELECT 'adapter_' || vec_id // 8 AS adapter, 't' || vec_id % 8 AS tensor_key,
       CASE WHEN vec_id % 8 IN (2, 3) THEN 'float16' WHEN vec_id % 8 IN (4, 5) THEN 'bfloat16' ELSE 'float32' END AS dtype,
       CAST(CASE WHEN vec_id % 8 = 6 THEN len(embedding) // 2 * 2 ELSE len(embedding) END AS BIGINT) AS n,
       CAST(CASE WHEN vec_id % 8 BETWEEN 2 AND 5 THEN 1 WHEN vec_id % 8 = 6 THEN 2 ELSE 0 END AS INT) AS dims,
       NOT (vec_id // 8 % 7 = 0 AND vec_id % 8 = 4) AS shape_ok
FROM embeddings"""
_defaults = list(C.ADAPTER_DEFAULTS.items())
SQL["adapter_configs"] = f"""
SELECT 'adapter_' || a AS adapter, CASE WHEN a % 3 = 0 THEN 'OTHER' ELSE {B.lit(_defaults[0][1])} END AS {_defaults[0][0]},
       {', '.join(f'{B.lit(v)} AS {k}' for k, v in _defaults[1:])}, CASE WHEN a % 3 = 0 THEN CAST(a AS VARCHAR) END AS rank,
       CAST(CASE WHEN a % 3 = 0 THEN 5 ELSE 4 END AS BIGINT) AS n_keys
FROM (SELECT DISTINCT vec_id // 8 AS a FROM embeddings)"""

SQL["shard_export"] = SQL["bucket_sizes"]
