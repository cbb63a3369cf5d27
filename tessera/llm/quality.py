"""Quality rules by distribution divergence (DataFrame functions only).

Base rules count words, symbols, repeated lines and words in repeated eight-word
windows.  A document that passes them is compared with a reference of its
language: the Jensen-Shannon distance between histograms of character classes,
and between histograms of common short words.  References are sums over all
documents of a language; a null language, or one below ``min_reference_words``,
uses the reference of the whole table.  A distance is only judged from
``min_words`` words on; shorter documents pass.

Null text counts as empty (no words: the base rules fail).  Rows are judged one
by one, so repeated rows, null or repeated ids and extra columns pass through;
input columns named like a result column are replaced.  An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.plan import fence
from .common import BLANKS, broadcast_if_small, saved, whole

SYMBOLS = "[^#*$%&|<>]"
WINDOW = 8
N_COMMON = 16
MAX_COMMON_CHARS = 6
MIN_WORDS = 50
MIN_REFERENCE_WORDS = 2_000
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.45
POOLED = "*"
#: Patterns of character classes, each counted in what the ones before have left; white space is last.
CLASSES = {
    "lower": r"\p{Ll}+",
    "blank": BLANKS,
    "upper": r"\p{Lu}+",
    "digit": r"\p{Nd}+",
    "stop": r"[.,;:!?'\"()\-]+",
    "symbol": r"[#*$%&|<>{}\[\]=+~^\\/@_]+",
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULT = [*COUNTS, "base_failed", "class_distance", "word_distance", "kept"]


def _class_counts(text: Column) -> Column:
    """Number of characters of each class, as an array of doubles."""
    counts, left = [], text
    for pattern in CLASSES.values():
        rest = F.regexp_replace(left, pattern, "")
        counts.append((F.length(left) - F.length(rest)).cast("double"))
        left = rest
    return F.array(*counts)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _short(words: Column) -> Column:
    """Lower-cased words short enough to be common ones."""
    return F.transform(F.filter(words, lambda w: F.length(w) <= MAX_COMMON_CHARS), F.lower)


def references(docs: DataFrame) -> DataFrame:
    """One row per language and one for all: ``ref_lang, ref_classes
    (histogram), ref_common (words), ref_words (histogram, the rest last)``."""
    d = docs.select(F.coalesce("lang", F.lit(POOLED)).alias("ref_lang"), whole().alias("t"))
    sums = d.select("ref_lang", _class_counts(F.col("t")).alias("c"), F.size(_words(F.col("t"))).alias("n")) \
        .groupBy("ref_lang").agg(*[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(len(CLASSES))], F.sum("n").alias("n"))
    sums = saved(sums, "quality-classes")
    parts = [f"c{i}" for i in range(len(CLASSES))]
    pooled = sums.agg(*[F.sum(c).alias(c) for c in [*parts, "n"]]).select(F.lit(POOLED).alias("ref_lang"), *parts, "n")
    sums = sums.where(F.col("ref_lang") != POOLED).unionByName(pooled)
    counted = d.select("ref_lang", F.explode(_short(_words(F.col("t")))).alias("w")).groupBy("ref_lang", "w").agg(F.count("*").alias("k"))
    counted = saved(counted, "quality-words")
    everywhere = counted.groupBy("w").agg(F.sum("k").alias("k")).select(F.lit(POOLED).alias("ref_lang"), "w", "k")
    counted = counted.where(F.col("ref_lang") != POOLED).unionByName(everywhere)
    by_rank = [F.desc("k"), F.asc("w")]
    # two steps, so that no task sees all words of a common language
    first = counted.withColumn("salt", F.pmod(F.xxhash64("w"), F.lit(64))) \
        .withColumn("r", F.row_number().over(W.partitionBy("ref_lang", "salt").orderBy(*by_rank))).where(F.col("r") <= N_COMMON)
    top = first.groupBy("ref_lang").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "w"))), 1, N_COMMON).alias("top"))
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    inside = F.aggregate("top", F.lit(0).cast("long"), lambda a, x: a - x["k"])
    return saved(
        sums.join(top, "ref_lang", "left").where((F.col("n") >= MIN_REFERENCE_WORDS) | (F.col("ref_lang") == POOLED)).select(
            "ref_lang",
            F.array(*[F.col(p) / F.greatest(total, F.lit(1.0)) for p in parts]).alias("ref_classes"),
            F.coalesce(F.transform("top", lambda x: x["w"]), F.array().cast("array<string>")).alias("ref_common"),
            F.concat(F.coalesce(F.transform("top", lambda x: -x["k"] / F.col("n")), F.array().cast("array<double>")),
                     F.array((F.col("n") - F.coalesce(inside, F.lit(0))) / F.greatest(F.col("n"), F.lit(1)))).alias("ref_words"),
        ),
        "quality-references",
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence to base 2, 0 to 1) of two histograms."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log(a * 2 / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / (2 * F.log(F.lit(2.0))), F.lit(0.0)))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda c: c / F.greatest(total, F.lit(1.0)))


def _base(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the counting columns of the base rules (prefix ``_q_``) over the whole text in column ``text``."""
    t = F.col(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"_q_words": _words(t), "_q_lines": lines})
    n = F.size("_q_words")
    df = df.withColumn("_q_each", F.transform("_q_words", lambda w: F.xxhash64(w)))
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("_q_each", i + k) for k in range(WINDOW)]))) \
        .otherwise(F.array().cast("array<bigint>"))
    df = df.withColumns({
        "_q_n_words": n.cast("long"),
        "_q_word_chars": F.length(F.regexp_replace(t, BLANKS, "")).cast("long"),
        "_q_n_symbols": F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long"),
        "_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "_q_hash": hashes,
    })
    # windows in order of hash and place, only where some hash repeats
    ordered = F.when(F.size(F.array_distinct("_q_hash")) < F.size("_q_hash"),
                     F.sort_array(F.transform("_q_hash", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i")))))
    df = df.withColumn("_q_order", ordered)
    same = lambda x, i: F.coalesce(F.get("_q_order", i)["h"] == x["h"], F.lit(False))
    twice = F.filter("_q_order", lambda x, i: same(x, i - 1) | same(x, i + 1))
    df = df.withColumn("_q_places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "_q_places", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + (WINDOW - 1)).alias("end"), (a["n"] + p + (WINDOW - 1) - F.greatest(a["end"], p - 1)).alias("n")),
        lambda a: a["n"])
    df = df.withColumn("_q_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return df.withColumn("_q_base_failed", (F.col("_q_n_words") < 20) | (100 * F.col("_q_n_repeat_words") > 30 * F.col("_q_n_words")))


def _literal(row) -> Column:
    """A reference row as a constant."""
    return F.struct(
        F.array(*[F.lit(x) for x in row["ref_classes"]]).cast("array<double>").alias("ref_classes"),
        F.array(*[F.lit(x) for x in row["ref_common"]]).cast("array<string>").alias("ref_common"),
        F.array(*[F.lit(x) for x in row["ref_words"]]).cast("array<double>").alias("ref_words"))


def _judged(docs: DataFrame, refs: DataFrame | None) -> DataFrame:
    """``docs`` with every column of ``RESULT`` under the prefix ``_q_``."""
    refs = references(docs) if refs is None else refs
    pooled = refs.where(F.col("ref_lang") == POOLED).first()  # one row
    named = refs.select(F.col("ref_lang").alias("_q_lang"), F.struct("ref_classes", "ref_common", "ref_words").alias("_q_ref"))
    d = docs.withColumn("_q_text", whole()).join(broadcast_if_small(named, refs.count(), 10_000), F.col("lang") == F.col("_q_lang"), "left")
    d = _base(d.withColumn("_q_ref", F.coalesce("_q_ref", _literal(pooled))), "_q_text")
    ref = F.col("_q_ref")
    d = d.withColumn("_q_at", F.filter(F.transform(_short(F.col("_q_words")), lambda w: F.array_position(ref["ref_common"], w)), lambda i: i > 0))
    found = F.transform(ref["ref_common"], lambda _, k: F.size(F.filter("_q_at", lambda i: i == k + 1)).cast("double"))
    d = d.withColumns({
        "_q_common": F.concat(found, F.array((F.col("_q_n_words") - F.size("_q_at")).cast("double"))),
        "_q_classes": _class_counts(F.col("_q_text")),
    })
    d = d.withColumns({
        "_q_class_distance": F.round(js_distance(_shares(F.col("_q_classes")), ref["ref_classes"]), 6),
        "_q_word_distance": F.round(js_distance(_shares(F.col("_q_common")), ref["ref_words"]), 6),
    })
    near = (F.col("_q_class_distance") <= MAX_CLASS_DISTANCE) & (F.col("_q_word_distance") <= MAX_WORD_DISTANCE)
    return d.withColumn("_q_kept", ~F.col("_q_base_failed") & ((F.col("_q_n_words") < MIN_WORDS) | near))


def _set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with no column of the helper prefix, and the names that its columns go by meanwhile."""
    names = {c: f"_own{c}" if c.lower().startswith("_q_") else c for c in docs.columns}
    return docs.select(*[F.col(c).alias(n) for c, n in names.items()]), names


def judge(docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """``docs`` with the columns of ``RESULT``; ``refs`` as made by ``references``."""
    plain, names = _set_aside(docs)
    own = [F.col(n).alias(c) for c, n in names.items() if c not in RESULT]
    return _judged(plain, refs).select(*own, *[F.col(f"_q_{c}").alias(c) for c in RESULT])


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.  The fence
    keeps the filter from being pushed below, which would repeat every rule's
    expression inside the condition."""
    plain, names = _set_aside(docs)
    kept = fence(_judged(plain, None).select(*plain.columns, "_q_kept")).where("_q_kept")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
