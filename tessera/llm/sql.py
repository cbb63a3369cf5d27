"""DuckDB SQL of the queries that SQL can express, written from their definition."""

from __future__ import annotations

MIXING = r"""
WITH RECURSIVE d AS (SELECT *, coalesce(text, '') AS t FROM documents),
sizes AS (SELECT source, sum(length(t))::DOUBLE AS size FROM d GROUP BY source),
totals AS (SELECT sum(size) AS size, sum(pow(size, 0.5)) AS shares FROM sizes),
rates AS (
  SELECT s.source, CASE WHEN s.size = 0 THEN 1.0 ELSE pow(s.size, 0.5) / t.shares * t.size / s.size END AS rate
  FROM sizes s, totals t),
parts AS (SELECT source, greatest(ceil(rate / 8.0), 1)::INT AS n, rate / greatest(ceil(rate / 8.0), 1) AS mean FROM rates),
cdf AS (
  SELECT source, mean, n, 1 AS k, exp(-mean) AS p, exp(-mean) AS c FROM parts
  UNION ALL
  SELECT source, mean, n, k + 1, p * mean / k, c + p * mean / k FROM cdf WHERE k < 64),
names AS (SELECT doc_id, source, '17|' || coalesce(doc_id::VARCHAR, md5(t)) AS name FROM d),
drawn AS (
  SELECT m.doc_id, m.source, m.name, j.j,
         ('0x' || substr(md5(m.name || '|' || j.j), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM names m JOIN parts p ON p.source IS NOT DISTINCT FROM m.source, LATERAL (SELECT unnest(range(1, p.n + 1)) AS j) j),
counts AS (
  SELECT r.name, count(*) AS n
  FROM drawn r JOIN cdf c ON c.source IS NOT DISTINCT FROM r.source AND r.u >= c.c
  GROUP BY r.name),
copies AS (SELECT m.doc_id, m.name, unnest(range(1, c.n + 1)) AS mix_copy FROM names m JOIN counts c ON c.name = m.name)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.mix_copy, md5(c.name || '|copy|' || c.mix_copy) AS mix_key
FROM copies c JOIN d ON d.doc_id = c.doc_id
"""

_CLASS_PATTERNS = [
    r"\p{Ll}+", r"[\x20\x09-\x0D]+", r"\p{Lu}+", r"\p{Nd}+", r"[.,;:!?''\"()\-]+", r"[#*$%&|<>{}\[\]=+~^\\/@_]+"]
_CLASS_LIST = ", ".join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))::DOUBLE" for p in _CLASS_PATTERNS)
_JS = """CASE WHEN {a} > 0 THEN {a} * ln({a} * 2 / ({a} + {b})) ELSE 0 END + CASE WHEN {b} > 0 THEN {b} * ln({b} * 2 / ({a} + {b})) ELSE 0 END"""


def _js(p: str, q: str) -> str:
    terms = _JS.format(a=f"{p}[i]", b=f"{q}[i]")
    return f"round(sqrt(greatest(list_sum([{terms} FOR i IN range(1, len({p}) + 1)]) / (2 * ln(2.0)), 0)), 6)"


QUALITY = rf"""
WITH d AS (
  SELECT doc_id, lang, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         [{_CLASS_LIST}] AS classes
  FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)),
languages AS (SELECT coalesce(lang, '*') AS l, classes, len(words) AS n FROM d),
class_sums AS (
  SELECT l, [sum(classes[1]), sum(classes[2]), sum(classes[3]), sum(classes[4]), sum(classes[5]), sum(classes[6])] AS c, sum(n) AS n
  FROM (SELECT * FROM languages WHERE l <> '*' UNION ALL SELECT '*', classes, n FROM languages) GROUP BY l),
short AS (SELECT coalesce(lang, '*') AS l, unnest([lower(w) FOR w IN words IF length(w) <= 6]) AS w FROM d),
counted AS (
  SELECT l, w, count(*) AS k FROM (SELECT * FROM short WHERE l <> '*' UNION ALL SELECT '*', w FROM short) GROUP BY l, w),
top AS (
  SELECT l, list(w ORDER BY k DESC, w) AS common, list(k ORDER BY k DESC, w) AS ks
  FROM (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY l ORDER BY k DESC, w) <= 16) GROUP BY l),
refs AS (
  SELECT s.l, [x / list_sum(s.c) FOR x IN s.c] AS ref_classes, coalesce(t.common, []) AS common,
         list_concat([k / s.n FOR k IN coalesce(t.ks, [])], [(s.n - coalesce(list_sum(t.ks), 0)) / greatest(s.n, 1)]) AS ref_words
  FROM class_sums s LEFT JOIN top t ON t.l = s.l WHERE s.n >= 2000 OR s.l = '*'),
windows AS (
  SELECT doc_id, p, array_to_string(words[p:p + 7], chr(31)) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS p FROM d WHERE len(words) >= 8)),
twice AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
repeated AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM twice, range(8) r(o) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup_lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT d.doc_id, d.classes, d.words, coalesce(own.l, '*') AS l,
         len(d.words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(u.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN refs own ON own.l = d.lang LEFT JOIN dup_lines u USING (doc_id) LEFT JOIN repeated r USING (doc_id)),
hits AS (
  SELECT b.doc_id, b.l, r.common, r.ref_classes, r.ref_words, b.classes, b.n_words,
         [list_position(r.common, lower(w)) FOR w IN b.words IF length(w) <= 6 AND list_contains(r.common, lower(w))] AS found
  FROM base b JOIN refs r ON r.l = b.l),
shares AS (
  SELECT doc_id, ref_classes, ref_words, [x / greatest(list_sum(classes), 1.0) FOR x IN classes] AS cs,
         [x / greatest(n_words, 1) FOR x IN list_concat([len([1 FOR a IN found IF a = k]) FOR k IN range(1, len(common) + 1)], [n_words - len(found)])] AS ws
  FROM hits),
distances AS (SELECT doc_id, {_js('cs', 'ref_classes')} AS class_distance, {_js('ws', 'ref_words')} AS word_distance FROM shares),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT f.doc_id, f.n_words::BIGINT AS n_words, f.word_chars::BIGINT AS word_chars, f.n_symbols::BIGINT AS n_symbols,
       f.n_dup_lines::BIGINT AS n_dup_lines, f.n_repeat_words::BIGINT AS n_repeat_words, f.base_failed,
       s.class_distance, s.word_distance,
       NOT f.base_failed AND (f.n_words < 50 OR (s.class_distance <= 0.30 AND s.word_distance <= 0.45)) AS kept
FROM failed f JOIN distances s USING (doc_id)
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""



def _vector_codes(rounds: int = 6) -> str:
    """Rounds of nearest entries and floored means, one pair of tables each."""
    near = """at{r} AS MATERIALIZED (
  SELECT vec_id, label, p, v, k, d FROM (
    SELECT a.vec_id, a.label, a.p, a.v, b.k, list_sum([(a.v[i] - b.v[i]) * (a.v[i] - b.v[i]) FOR i IN range(1, len(a.v) + 1)])::BIGINT AS d
    FROM parts a JOIN book{r} b ON b.p = a.p)
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, k) = 1)"""
    mean = """book{n} AS MATERIALIZED (
  SELECT b.p, b.k, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN (
    SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v
    FROM (SELECT p, k, i, sum(x)::BIGINT AS s, count(*) AS n
          FROM (SELECT p, k, unnest(v) AS x, unnest(range(len(v))) AS i FROM at{r}) GROUP BY p, k, i)
    GROUP BY p, k) m ON m.p = b.p AND m.k = b.k)"""
    steps = [x.format(r=r, n=r + 1) for r in range(rounds) for x in (near, mean)] + [near.format(r=rounds)]
    return """
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, p, e[p * (len(e) // 8) + 1 : (p + 1) * (len(e) // 8)] AS v FROM (SELECT *, unnest(range(8)) AS p FROM kept)),
book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, v FROM parts QUALIFY k < 16),
""" + ",\n".join(steps) + f"""
SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error,
       (sum(sum(d)) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) FROM book{rounds}) AS codebooks_sha256
FROM at{rounds} GROUP BY vec_id, label
"""


JACCARD = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                      ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END)) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT c.x, c.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL) c
  JOIN n p ON p.doc_id = c.x JOIN n q ON q.doc_id = c.y WHERE 100 * c.c >= 80 * (p.n + q.n - c.c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) m USING (doc_id)
"""

SQL = {"op5_mixing": MIXING, "op8_quality": QUALITY, "op9_topk": TOP_K, "op11_vector_codes": _vector_codes(), "op13_jaccard": JACCARD}
