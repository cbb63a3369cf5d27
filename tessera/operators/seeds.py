"""Q-10..Q-14, O-3, A-14, S-7, W-3: seed selection and the seed loader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions import text as X
from ..functions.plan import fence

SEED_SOURCE = "MELD"


def target_emotions(include_low_intensity: bool = True) -> list[str]:
    """Q-10: neutral emotions, plus the low-intensity ones when enabled."""
    return C.NEUTRAL_EMOTIONS + (C.LOW_INTENSITY_EMOTIONS if include_low_intensity else [])


def classify_seeds(src: DataFrame, include_low_intensity: bool = True,
                   min_words: int = C.SEED_MIN_WORDS, max_words: int = C.SEED_MAX_WORDS) -> DataFrame:
    """Clean every row (Q-11) and classify it (Q-12).

    ``seed_reason`` is the classifier's verdict on the cleaned text
    (``cleaning_failed`` when cleaning rejects it); ``reason`` is the
    funnel reason, which first drops non-target emotions (Q-10).
    """
    emotion = F.lower(F.col("emotion"))
    cleaned = X.clean_seed(F.col("text"))
    df = fence(src.withColumn("emotion", emotion).withColumn("cleaned", cleaned))
    verdict = F.when(F.col("cleaned").isNull(), F.lit("cleaning_failed")).otherwise(
        X.seed_reason(F.col("cleaned"), min_words, max_words))
    target = F.col("emotion").isin(target_emotions(include_low_intensity))
    return fence(df.select(
        "conv_id", "turn", "emotion", "cleaned",
        target.alias("target_emotion"),
        verdict.alias("seed_reason"),
        F.when(~target, F.lit("not_target_emotion")).otherwise(verdict).alias("reason"),
    ))


def seed_rows(classified: DataFrame) -> DataFrame:
    """Accepted seeds in the seed-file schema (K-7)."""
    return classified.filter(F.col("reason") == "good_seed").select(
        F.col("cleaned").alias("utterance"),
        F.lit(SEED_SOURCE).alias("source"),
        F.col("emotion"),
        F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("origin_id"),
        X.word_count(F.col("cleaned")).cast("long").alias("word_count"),
        F.col("conv_id"), F.col("turn"),
    )


def first_seeds(classified: DataFrame, max_samples: int = C.SEED_MAX_SAMPLES) -> DataFrame:
    """O-3: the first ``max_samples`` accepted seeds in input order.  Spark
    plans this as a per-partition top-k merged on the driver (bounded by
    ``max_samples``), not a global sort."""
    return seed_rows(classified).orderBy("conv_id", "turn").limit(max_samples).drop("conv_id", "turn")


def skip_reasons(classified: DataFrame) -> DataFrame:
    """A-14: funnel reasons over target-emotion rows."""
    return (classified.filter(F.col("target_emotion")).groupBy("reason")
            .agg(F.count(F.lit(1)).alias("n")))


def emotion_distribution(classified: DataFrame) -> DataFrame:
    """A-1 / A-14: label frequency over every row, before any filter."""
    return classified.groupBy("emotion").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ loader ---

LOADER_JSON = T.StructType([
    T.StructField("utterance", T.StringType()),
    T.StructField("dialogue", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def first_lines_per_file(lines: DataFrame, n: int) -> DataFrame:
    """W-3: keep the first ``n`` lines of every file.

    Lines carry (file, split start, id); ids are contiguous inside a split,
    so a line's rank in its split is ``id - min(id)``.  Per-split line counts
    (one row per split) give each split's offset in its file; no window ever
    spans more than the per-split summary, so a huge file never lands in
    one task.
    """
    split_stats = lines.groupBy("file", "block_start").agg(
        F.min("line_id").alias("first_id"), F.count(F.lit(1)).alias("n_lines"))
    from pyspark.sql import Window
    w = Window.partitionBy("file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = split_stats.withColumn("offset", F.coalesce(F.sum("n_lines").over(w), F.lit(0)))
    ranked = lines.join(offsets, ["file", "block_start"]).withColumn(
        "line_no", F.col("offset") + F.col("line_id") - F.col("first_id"))
    return ranked.filter(F.col("line_no") < n).drop("first_id", "n_lines", "offset")


def read_seed_lines(spark, paths, max_per_file: int = C.LOADER_MAX_LINES_PER_FILE) -> DataFrame:
    """S-7: seed files, each line JSON (first truthy of utterance/dialogue/
    text) or else plain text; the first ``max_per_file`` lines of each file
    (bad lines count); Q-14 keeps 8 < words < 30."""
    raw = spark.read.text(paths).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"),
    )
    lines = first_lines_per_file(raw, max_per_file)
    parsed = F.from_json(F.col("value"), LOADER_JSON, {"columnNameOfCorruptRecord": "_corrupt_record"})
    df = lines.withColumn("j", parsed)
    is_json = F.col("j").isNotNull() & F.col("j._corrupt_record").isNull() & \
        F.col("value").rlike(r"^\s*\{")

    def truthy(c):
        return F.when(c != "", c)

    json_text = F.coalesce(truthy(F.col("j.utterance")), truthy(F.col("j.dialogue")), truthy(F.col("j.text")))
    text = F.when(is_json, json_text).otherwise(X.py_strip(F.col("value")))
    n = X.word_count(text)
    keep = text.isNotNull() & (text != "") & (n > C.LOADER_MIN_WORDS_EXCL) & (n < C.LOADER_MAX_WORDS_EXCL)
    return df.filter(keep).select(
        X.py_strip(text).alias("seed"), "file", "line_no")
