"""R-1..R-6, J-4..J-6, U-2: shard fingerprints, the training-run plan, the
job registry and coverage audits -- the bookkeeping around fine-tuning,
as table jobs (the fine-tuning service itself is external).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from .sample import hash32

UNIT_SEP = "\u001f"


def row_digest(*cols: str) -> Column:
    return F.md5(F.concat_ws(UNIT_SEP, *[F.col(c) for c in cols]))


def shard_fingerprints(rows: DataFrame, content_cols=("prompt", "completion")) -> DataFrame:
    """R-1: order-insensitive content fingerprint per shard (bucket).

    Each row's md5 is split into four 32-bit words; the shard digest is the
    md5 of (count, four word sums).  Sums are partial aggregates, so the
    fingerprint is one linear pass, independent of row order and of the
    number of partitions, and never collects a shard.  Sums are decimals of
    38 digits, exact for any number of rows.
    """
    d = row_digest(*content_cols)
    words = [F.conv(F.substring(d, 8 * i + 1, 8), 16, 10).cast("decimal(10,0)").alias(f"w{i}") for i in range(4)]
    per_row = rows.select("bucket", *words)
    agg = per_row.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(F.col(f"w{i}").cast("decimal(28,0)")).alias(f"s{i}") for i in range(4)])
    fp = F.md5(F.concat_ws(":", F.col("n_rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)]))
    return agg.select(
        "bucket", F.concat(F.col("bucket"), F.lit(".jsonl")).alias("file_name"), "n_rows", fp.alias("hash"))


def job_id_for(hash_col: Column, salt: str) -> Column:
    h = F.md5(F.concat(F.lit(salt), F.lit("|"), hash_col))
    return F.concat(F.lit("ft-"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4))


STATUS_CYCLE = [C.STATUS_COMPLETED, C.STATUS_FAILED, C.STATUS_CANCELLED, C.STATUS_RUNNING]


def registry_from_run(fingerprints: DataFrame, created_base: float = 1.75e9) -> DataFrame:
    """A registry as a previous run leaves it: one row per fingerprint with
    its job id, file name, trait, creation time and last known status."""
    h = F.col("hash")
    return fingerprints.select(
        "hash",
        job_id_for(h, "job").alias("job_id"),
        "file_name",
        F.col("bucket").alias("trait"),
        (F.lit(created_base) + F.pmod(hash32(h, salt="created"), F.lit(100000)).cast("double")).alias("created_at"),
        F.element_at(F.array(*[F.lit(s) for s in STATUS_CYCLE]),
                     (F.pmod(hash32(h, salt="status"), F.lit(len(STATUS_CYCLE))) + 1).cast("int")).alias("status"),
    )


def run_plan(current: DataFrame, registry: DataFrame, force_retrain: bool = False) -> DataFrame:
    """R-2 with J-5: per shard, launch / skip_completed / retry_failed /
    in_progress, reusing the registered job id where it stays valid.
    ``force_retrain`` ignores the registry (R-3: it is cleared)."""
    reg = registry.select("hash", F.col("job_id").alias("known_job"), "status")
    if force_retrain:
        reg = reg.limit(0)
    j = current.join(reg, "hash", "left")
    status = F.col("status")
    action = (F.when(status.isNull(), F.lit("launch"))
              .when(status == C.STATUS_COMPLETED, F.lit("skip_completed"))
              .when(status.isin(C.TERMINAL_FAILURES), F.lit("retry_failed"))
              .otherwise(F.lit("in_progress")))
    return j.select(
        "bucket", "file_name", "n_rows", "hash", action.alias("action"),
        F.when(action.isin("skip_completed", "in_progress"), F.col("known_job")).alias("job_id"),
    )


def registry_upsert(registry: DataFrame, plan: DataFrame, now: float) -> DataFrame:
    """R-3: drop entries of failed jobs being retried, add entries for new
    launches, keep the latest entry per hash."""
    relaunch = plan.filter(F.col("action").isin("launch", "retry_failed"))
    kept = registry.join(relaunch.select("hash"), "hash", "left_anti").select(
        "hash", "job_id", "file_name", "trait", "created_at")
    new = relaunch.select(
        "hash", job_id_for(F.col("hash"), f"job@{now}").alias("job_id"), "file_name",
        F.col("bucket").alias("trait"), F.lit(float(now)).alias("created_at"))
    w = Window.partitionBy("hash").orderBy(F.desc("created_at"), F.desc("job_id"))
    return (kept.unionByName(new).withColumn("rn", F.row_number().over(w))
            .filter(F.col("rn") == 1).drop("rn"))


EVENT_STATUS = {
    "purchase": C.STATUS_COMPLETED,
    "error": C.STATUS_FAILED,
    "view": C.STATUS_RUNNING,
    "click": C.STATUS_RUNNING,
    "signup": "pending",
}


def job_status_log(events: DataFrame) -> DataFrame:
    """A job status log derived from an event stream: job = user, status =
    event type mapped to a service status."""
    status = None
    for k, v in EVENT_STATUS.items():
        status = F.when(F.col("event_type") == k, F.lit(v)) if status is None else status.when(
            F.col("event_type") == k, F.lit(v))
    return events.select(
        F.concat(F.lit("ft-"), F.col("user_id").cast("string")).alias("job_id"),
        "ts", "event_id", status.otherwise(F.lit(C.STATUS_CANCELLED)).alias("status"))


def terminal_status(log: DataFrame) -> DataFrame:
    """R-5: latest status per job (``max_by`` on (ts, event_id), a partial
    aggregate) and whether the job is finished."""
    latest = log.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max_by("status", F.struct("ts", "event_id")).alias("last_status"))
    s = F.col("last_status")
    return latest.withColumn(
        "outcome",
        F.when(s == C.STATUS_COMPLETED, F.lit("completed"))
        .when(s.isin(C.TERMINAL_FAILURES), F.lit("failed"))
        .otherwise(F.lit("remaining")))


def requested_buckets(spark: SparkSession, names: list[str] | None = None, all_poles: bool = False,
                      traits: list[str] = C.PLANNER_TRAITS) -> DataFrame:
    """R-4: scope -- all poles of the planner trait list, a named subset, or
    (``None``) nothing explicit.  ``--all`` with names is rejected."""
    if all_poles and names:
        raise ValueError("Cannot use --all with specific trait arguments")
    if all_poles:
        names = [f"{t}_{p}" for t in traits for p in ("plus", "minus")]
    schema = T.StructType([T.StructField("bucket", T.StringType(), False)])
    return F.broadcast(spark.createDataFrame([(n,) for n in (names or [])], schema))


def coverage_audit(requested: DataFrame, available: DataFrame) -> DataFrame:
    """R-6 / J-4 / J-6 / U-2: requested poles with or without a shard, and
    shards nobody requested (left join + left anti, no full outer join)."""
    req = requested.join(available, "bucket", "left").select(
        "bucket", F.lit(True).alias("requested"),
        F.col("n_rows").isNotNull().alias("available"),
        F.coalesce(F.col("n_rows"), F.lit(0)).cast("long").alias("n_rows"))
    extra = available.join(requested, "bucket", "left_anti").select(
        "bucket", F.lit(False).alias("requested"), F.lit(True).alias("available"),
        F.col("n_rows").cast("long").alias("n_rows"))
    out = req.unionByName(extra)
    status = (F.when(F.col("requested") & F.col("available"), F.lit("ready"))
              .when(F.col("requested"), F.lit("missing")).otherwise(F.lit("unrequested")))
    return out.withColumn("status", status)
