"""K-1..K-9: corpus, shard, seed, prompt and table writers.

Everything is written in parallel by the executors.  The single JSON array
(K-4) is written as parts that give one valid array when they are put together
in the order of their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..session import written

TRAITS_STRUCT = T.StructType([T.StructField(t, T.DoubleType()) for t in C.TRAITS])
NESTED_SCHEMA = T.StructType([
    T.StructField("utterance", T.StringType()),
    T.StructField("traits", TRAITS_STRUCT),
    T.StructField("source_metadata", T.StructType([
        T.StructField("source", T.StringType()),
        T.StructField("origin_id", T.StringType()),
        T.StructField("original_tag", T.StringType()),
        T.StructField("original_seed", T.StringType()),
    ])),
])


def nested(corpus: DataFrame, *keep: str) -> DataFrame:
    """P-4 / P-10: flat corpus row -> nested export record (length and word
    count are dropped, traits packed in fixed order)."""
    return corpus.select(
        "utterance",
        F.struct(*[F.col(f"trait_{t}").alias(t) for t in C.TRAITS]).alias("traits"),
        F.struct("source", "origin_id", "original_tag").alias("source_metadata"),
        *keep,
    )


def flat(nested_df: DataFrame) -> DataFrame:
    """P-4 inverse: nested record -> flat trait columns."""
    return nested_df.select(
        "utterance",
        *[F.col(f"traits.{t}").alias(f"trait_{t}") for t in C.TRAITS],
        F.col("source_metadata.source").alias("source"),
        F.col("source_metadata.origin_id").alias("origin_id"),
        F.col("source_metadata.original_tag").alias("original_tag"),
    )


def flat_synthetic(rows: DataFrame) -> DataFrame:
    """Synthetic rows with flat columns, the original seed and the bucket."""
    return rows.select(
        "utterance",
        *[F.col(f"traits.{t}").alias(f"trait_{t}") for t in C.TRAITS],
        F.col("source_metadata.source").alias("source"),
        F.col("source_metadata.origin_id").alias("origin_id"),
        F.col("source_metadata.original_tag").alias("original_tag"),
        F.col("source_metadata.original_seed").alias("original_seed"),
        "bucket",
    )


def export_corpus(corpus: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """K-1..K-4, K-9: write the corpus as parquet, CSV with header, nested
    JSONL, or (``json``) one nested JSON array; other formats are rejected."""
    if fmt not in C.EXPORT_FORMATS:
        raise ValueError(f"Unsupported output format: {fmt}")
    if fmt == "parquet":
        corpus.write.mode(mode).parquet(path)
    elif fmt == "csv":
        corpus.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        write_json_array(nested(corpus), path, mode)
    else:
        nested(corpus).write.mode(mode).json(path)


def write_json_array(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K-4: one JSON array in parts.  Rows are numbered and written first; then
    each is a line that begins with a comma, the first one with the opening
    bracket, and the last one ends with the closing bracket.  Parts are ranges of
    the numbers, so their names are in order."""
    numbered = written(rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).withColumn("id", F.monotonically_increasing_id()), "json-array")
    first, last = numbered.agg(F.min("id"), F.max("id")).first()  # two numbers
    if first is None:
        rows.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode(mode).text(path)
        return
    head = F.when(F.col("id") == first, F.lit("[")).otherwise(F.lit(","))
    tail = F.when(F.col("id") == last, F.lit("]")).otherwise(F.lit(""))
    lines = numbered.repartitionByRange("id").sortWithinPartitions("id")
    lines.select(F.concat(head, "value", tail).alias("value")).write.mode(mode).text(path)


def read_json_array(spark, path: str, schema: T.StructType = NESTED_SCHEMA) -> DataFrame:
    """Rows of an array that ``write_json_array`` wrote."""
    line = F.regexp_replace(F.regexp_replace("value", r"^[\[,]", ""), r"\]$", "")
    lines = spark.read.text(path).select(line.alias("value")).filter(F.col("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def read_csv_corpus(spark, path: str, schema: T.StructType) -> DataFrame:
    """Read back a CSV export (multi-line quoted utterances)."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def write_shards(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K-5 / K-6: one directory per bucket (``bucket=<name>``), overwrite for
    a full split, append for a fill.  Rows are rebalanced by bucket, so a large
    bucket is written by several tasks and a small one by one."""
    rows.hint("rebalance", F.col("bucket")).write.mode(mode).partitionBy("bucket").json(path)


def write_splits(rows: DataFrame, path: str, column: str = "split", mode: str = "overwrite") -> None:
    """S-11: one folder per split, so that a read of one split opens no file of another."""
    rows.hint("rebalance", F.col(column)).write.mode(mode).partitionBy(column).parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", max_per_file: int = 0) -> None:
    """K-7: seeds, prompt/completion rows; ``max_per_file`` lines in a file at most (0: no limit)."""
    df.write.mode(mode).option("maxRecordsPerFile", max_per_file).json(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K-8: mapping / registry / vector tables as parquet."""
    df.write.mode(mode).parquet(path)
