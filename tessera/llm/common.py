"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path, written

#: Java pattern of the characters between words.
BLANKS = r"[\x20\x09-\x0D]+"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that workers
    started in another folder can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    target = os.path.join(SparkFiles.getRootDirectory(), "tessera_src.zip")
    with open(target, "wb") as f:
        f.write(buffer.getvalue())
    sc.addPyFile(target)
    sc._tessera_shipped = True


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores in front until no column of ``taken`` has it."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and reread:
    computed once, lineage cut, readable by every executor."""
    return written(df, name)


def in_buckets(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Like ``saved``, in buckets by ``key``: a join on it with rows dealt to as
    many partitions does not shuffle ``df``.  The catalog entry is only needed
    while the buckets are told to the reader."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, name)
    table = "tessera_" + uuid.uuid4().hex
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved before the entry goes; the files of a table with a path of its own stay
    spark.sql(f"DROP TABLE {table}")
    return out


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that ``column`` holds about ``limit`` bytes in each
    part; a longer single text is a part of its own."""
    n, start = batch.num_rows, 0
    if n == 0:
        return
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    total = 0
    for i in range(n):
        size = sizes[i] or 0
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start)


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers first.  A worker goes on to
    other tasks, so at the end it returns the memory that it has no use for."""
    ship_package(df.sparkSession)

    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast hint only where the counted ``rows`` stay within ``limit``;
    beyond it the join shuffles and adaptive execution splits skewed keys."""
    return F.broadcast(df) if rows <= limit else df


def whole(text: Column | str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def with_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` and ``rank`` (from 1) by ``order``: rows are sorted in ranges, written, and numbered by the sizes of the ranges before theirs."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order) \
        .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = saved(placed, name)
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    return placed.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_start") + F.col("_at") + 1).drop("_part", "_start", "_at")
