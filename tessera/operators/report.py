"""A-1..A-14, W-2, J-3: the processing funnel and the data-quality report.

The original report runs one query per trait and one per source; here each
report is a single pass: ``unpivot`` turns the ten trait columns into rows so one
``groupBy(trait, source)`` covers all of them, and the top-tags list is one
window over (source, tag) counts.  All aggregates are partial
(map-side combined) before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from .label import all_zero

PROCESSED = "processed"


def skip_funnel(classified: DataFrame) -> DataFrame:
    """A-2: rows per (source, reason); kept rows count as ``processed``."""
    return classified.groupBy(
        "source", F.coalesce(F.col("reason"), F.lit(PROCESSED)).alias("reason")
    ).agg(F.count(F.lit(1)).alias("n"))


def sampled_strata() -> Column:
    """A-4: whether a row lies in a down-sampled (source, tag) stratum."""
    cond = F.lit(False)
    for source, tag, _ in C.SAMPLING_STRATA:
        if tag is not None:
            cond = cond | ((F.col("source") == source) & (F.col("original_tag") == tag))
    return cond


def before_and_after(raw: DataFrame, keys: list[str], kept: Column) -> DataFrame:
    """A-4, A-5: rows per key before and after sampling, counted in one pass
    over the unsampled corpus; before first, then the largest first."""
    both = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("before"), F.count_if(kept).alias("after"))
    rows = both.select(*keys, F.explode(F.array(
        F.struct(F.lit("before").alias("stage"), F.col("before").alias("n")),
        F.struct(F.lit("after").alias("stage"), F.col("after").alias("n")))).alias("r"))
    return rows.select(*keys, "r.n", "r.stage").filter("n > 0").orderBy(F.desc("stage"), F.desc("n"), *keys)


def reduction_summary(raw: DataFrame, kept: Column) -> DataFrame:
    """A-6: totals before/after sampling, the reduction and its percentage,
    in one aggregation over the unsampled corpus (``kept`` is the sampling
    predicate)."""
    agg = raw.agg(F.count(F.lit(1)).alias("total_before"), F.count_if(kept).alias("total_after"))
    return agg.select(
        "total_before", "total_after",
        (F.col("total_before") - F.col("total_after")).alias("reduction"),
        F.round(F.when(F.col("total_before") > 0,
                       (F.col("total_before") - F.col("total_after")) * 100.0 / F.col("total_before")), 6
                ).alias("reduction_pct"),
    )


def source_stats(corpus: DataFrame) -> DataFrame:
    """A-7 + A-3: per-source counts, length and word statistics, distinct
    tags and distinct origins in one aggregation."""
    return corpus.groupBy("source").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.round(F.avg("utterance_length"), 6).alias("avg_length"),
        F.min("utterance_length").alias("min_length"),
        F.max("utterance_length").alias("max_length"),
        F.round(F.avg("word_count"), 6).alias("avg_words"),
        F.count_distinct("original_tag").alias("unique_tags"),
        F.count_distinct("origin_id").alias("unique_origins"),
    ).orderBy("source")


def unpivot_traits(corpus: DataFrame) -> DataFrame:
    """(source, trait, value) with one row per trait per corpus row."""
    return corpus.select("source", *C.TRAIT_COLUMNS).unpivot(
        ["source"], C.TRAIT_COLUMNS, "trait_col", "value"
    ).select("source", F.regexp_replace("trait_col", "^trait_", "").alias("trait"), "value")


def trait_polarity(corpus: DataFrame) -> DataFrame:
    """A-8: for every (trait, source): positive / negative / zero counts and
    avg / min / max.  The average is rounded to six decimals so it does not
    depend on summation order; min/max are exact."""
    v = F.col("value")
    return unpivot_traits(corpus).groupBy("trait", "source").agg(
        F.count(F.when(v > 0, 1)).alias("positive"),
        F.count(F.when(v < 0, 1)).alias("negative"),
        F.count(F.when(v == 0, 1)).alias("neutral"),
        F.round(F.avg(v), 6).alias("avg_value"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
    ).orderBy("trait", "source")


def top_tags(corpus: DataFrame, k: int = C.TOP_TAGS) -> DataFrame:
    """W-2 / O-2: the ``k`` most frequent tags per source (ties by name).
    The window runs over the per-(source, tag) counts, not over rows."""
    counts = corpus.groupBy("source", "original_tag").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("n"), F.asc_nulls_first("original_tag"))
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).orderBy("source", "rank")


def quality_issues(corpus: DataFrame) -> DataFrame:
    """A-9..A-11: short / long / all-zero-trait counts per source in one pass."""
    return corpus.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("utterance_length") < C.SHORT_UTTERANCE_CHARS).alias("short_utterances"),
        F.count_if(F.col("utterance_length") > C.LONG_UTTERANCE_CHARS).alias("long_utterances"),
        F.count_if(all_zero()).alias("all_zero_traits"),
    ).orderBy("source")

