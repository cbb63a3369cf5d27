"""D-5, micro-batch form: fill trait buckets from a stream of paraphrase
responses with Structured Streaming.

Each micro-batch (``foreachBatch``) is deduplicated against every row already
accepted -- earlier batches, earlier runs and shards written before -- greedy
in candidate order, cut at each bucket's remaining need and appended to the
shard table.

A batch is named by run and epoch; the run's name is kept in the stream's
checkpoint folder, so a stream with a new checkpoint never mistakes its epochs
for those of another.  The shard rows of a batch are written in one commit, after
its band keys; band keys count only if their batch has shard rows.  So a batch
that is replayed after a crash at any point is either skipped (its rows are
there) or done again as if for the first time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions.plan import evenly
from ..operators import dedup as D
from ..operators import shards as B
from ..sinks.writers import NESTED_SCHEMA

SHARD_SCHEMA = T.StructType([
    *NESTED_SCHEMA.fields,
    T.StructField("run", T.StringType()),
    T.StructField("epoch", T.LongType()),
    T.StructField("bucket", T.StringType()),
])
#: Run of shard rows that no stream has written.
EARLIER = ""


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def read_shards(spark: SparkSession, shard_path: str) -> DataFrame:
    """Shard rows with a fixed schema; an absent or empty folder gives none."""
    if not _exists(spark, shard_path):
        return spark.createDataFrame([], SHARD_SCHEMA)
    return spark.read.schema(SHARD_SCHEMA).json(shard_path)


def _members(rows: DataFrame, node: str) -> DataFrame:
    keep = ("bucket",)
    return D.band_keys(D.signatures(evenly(rows), node, "text", keep), keep=keep)


def index_earlier_shards(spark: SparkSession, shard_path: str, bands_path: str) -> None:
    """Band keys of shard rows that no stream has written (once: later calls find them)."""
    earlier = read_shards(spark, shard_path).filter(F.col("run").isNull())
    done = _exists(spark, bands_path) and not spark.read.parquet(bands_path).filter(F.col("run") == EARLIER).isEmpty()
    if done or earlier.isEmpty():
        return
    rows = earlier.select("bucket", F.col("utterance").alias("text"), F.lit(0).alias("node"))
    (_members(rows, "node").select("band_key", "bucket", F.lit(EARLIER).alias("run"), F.lit(-1).cast("long").alias("epoch"))
     .distinct().write.mode("append").parquet(bands_path))


def make_batch_writer(spark: SparkSession, shard_path: str, bands_path: str, target: int = C.TARGET_PER_BUCKET,
                      run: str = "run"):
    """foreachBatch body: (batch of node, bucket, text, seed) -> appended shard rows."""

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        shard = read_shards(spark, shard_path)
        if not shard.filter((F.col("run") == run) & (F.col("epoch") == epoch_id)).isEmpty():
            return  # this batch is committed
        counts = shard.groupBy("bucket").agg(F.count(F.lit(1)).alias("existing"))
        needs = (B.fill_needs(spark, spark.createDataFrame([], "bucket string"), target)
                 .select("bucket").join(counts, "bucket", "left")
                 .select("bucket", F.greatest(F.lit(target) - F.coalesce("existing", F.lit(0)), F.lit(0)).alias("need")))
        members = _members(batch, "node").checkpoint(eager=True)  # read for the verdict and again for the bands that are kept
        pre = None
        if _exists(spark, bands_path):
            committed = shard.select(F.coalesce("run", F.lit(EARLIER)).alias("run"), F.coalesce("epoch", F.lit(-1)).alias("epoch")).distinct()
            pre = spark.read.parquet(bands_path).join(committed, ["run", "epoch"], "left_semi")
        verdict = D.greedy_accept(members, preaccepted=pre, group_col="bucket")
        w = Window.partitionBy("bucket").orderBy("node")
        accepted = (batch.join(verdict.filter("accepted"), "node", "left_semi")
                    .join(F.broadcast(needs), "bucket")  # at most 20 rows
                    .withColumn("rank", F.row_number().over(w))
                    .filter((F.col("rank") <= F.lit(target)) & (F.col("rank") <= F.col("need")))
                    .drop("rank", "need"))
        accepted = accepted.checkpoint(eager=True)
        (members.join(accepted.select("node"), "node", "left_semi")
         .select("band_key", "bucket", F.lit(run).alias("run"), F.lit(epoch_id).cast("long").alias("epoch"))
         .write.mode("append").parquet(bands_path))
        (B.synthetic_rows(accepted).withColumn("run", F.lit(run)).withColumn("epoch", F.lit(epoch_id).cast("long"))
         .write.mode("append").partitionBy("bucket").json(shard_path))

    return write_batch


def start_fill(spark: SparkSession, candidates: DataFrame, shard_path: str, bands_path: str,
               checkpoint_location: str, target: int = C.TARGET_PER_BUCKET, available_now: bool = True):
    """Start the fill stream; ``candidates`` is a streaming DataFrame of
    (node, bucket, text, seed)."""
    index_earlier_shards(spark, shard_path, bands_path)
    named = f"{checkpoint_location.rstrip('/')}/fill-run"
    if not _exists(spark, f"{named}/_SUCCESS"):
        spark.createDataFrame([(uuid.uuid4().hex,)], "run string").coalesce(1).write.mode("overwrite").text(named)
    run = spark.read.text(named).first()[0]
    writer = candidates.writeStream.foreachBatch(make_batch_writer(spark, shard_path, bands_path, target, run)) \
        .option("checkpointLocation", checkpoint_location)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
