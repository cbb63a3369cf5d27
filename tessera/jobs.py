"""User-facing jobs: each takes input paths and writes its output, with the
parameters of the command it stands for.  The job itself is the composition of
the operators; nothing passes through the driver but counts."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import constants as C
from .operators import label as L
from .operators import registry as RG
from .operators import report as R
from .operators import sample as S
from .operators import seeds as SD
from .operators import shards as B
from .session import ensure_checkpoint_dir, written
from .sinks import writers as K
from .sinks.versioned import VersionedTable
from .sources import adapters as A
from .sources import files as FS
from .sources import mapping as M
from .sources.readers import read_source
from .streaming import fill as ST

REGISTRY_SCHEMA = "hash string, job_id string, file_name string, trait string, created_at double, status string"


def build_corpus(spark: SparkSession, sources: dict[str, str], output_dir: str, output_format: str = "parquet",
                 split: str | None = None, input_format: str = "json") -> DataFrame:
    """Read the sources (kind -> path, kinds of ``readers.SCHEMAS``), label and
    filter them, balance them by sampling, write the corpus and return its
    funnel.  The emotion mapping is stored beside it."""
    ensure_checkpoint_dir(spark)
    emotions, numeric = M.emotion_dim(spark), M.numeric_dim(spark)
    label = {
        "roles": lambda d: L.label_roles(d, emotions),
        "dialogues": lambda d: L.label_dialogue(A.explode_dialogue(d), numeric),
        "int_labels": lambda d: L.label_int(d, emotions),
        "string_labels": lambda d: L.label_string(d, emotions),
        "activations": L.label_activations,
    }
    unknown = sorted(set(sources) - set(label))
    if unknown:
        raise ValueError(f"Unknown sources: {unknown}. Available: {sorted(label)}")
    parts = [label[kind](read_source(spark, kind, path, input_format, split)) for kind, path in sources.items()]
    classified = written(reduce(lambda a, b: a.unionByName(b), parts), "classified")
    K.export_corpus(S.stratified_sample(L.kept(classified)), f"{output_dir}/corpus", output_format)
    K.write_table(emotions, f"{output_dir}/emotion_mapping")
    return R.skip_funnel(classified)


def make_seeds(spark: SparkSession, source: str, output: str, max_samples: int = C.SEED_MAX_SAMPLES,
               split: str | None = None, include_low_intensity: bool = True, input_format: str = "json") -> DataFrame:
    """Select seed sentences from a string-labelled source, write the first
    ``max_samples`` as JSON lines and return the skip reasons."""
    ensure_checkpoint_dir(spark)
    rows = read_source(spark, "string_labels", source, input_format, split).select(
        "emotion", "text", F.col("row_idx").alias("conv_id"), F.lit(0).cast("long").alias("turn"))
    classified = written(SD.classify_seeds(rows, include_low_intensity), "seeds")
    K.write_jsonl(SD.first_seeds(classified, max_samples), output)
    return SD.skip_reasons(classified)


def bucketize(spark: SparkSession, in_path: str, out_dir: str, min_rows: int = C.MIN_PER_BUCKET) -> DataFrame:
    """Split a nested JSONL corpus into trait-pole shards; buckets below
    ``min_rows`` are not written.  Returns every bucket's size and whether it
    was kept.  A malformed line is an error."""
    ensure_checkpoint_dir(spark)
    rows = written(B.bucket_rows(K.flat(FS.read_corpus_jsonl(spark, in_path, strict=True))), "bucket-rows")
    K.write_shards(K.nested(B.kept_bucket_rows(rows, min_rows), "bucket"), out_dir)
    return B.bucket_sizes(rows, min_rows)


def convert(spark: SparkSession, shard_dir: str, out_dir: str) -> DataFrame:
    """Turn shards into prompt/completion lines, one folder per bucket, and
    return the rows per bucket with the total."""
    ensure_checkpoint_dir(spark)
    shards = ST.read_shards(spark, shard_dir)
    rows = shards.select("bucket", "utterance", *[F.col(f"traits.{t}").alias(f"trait_{t}") for t in C.TRAITS])
    prompts = written(B.prompt_rows(rows).select("bucket", "prompt", "completion"), "prompts")
    K.write_shards(prompts, out_dir)
    return B.converted_counts(prompts)


def list_traits() -> list[str]:
    """Names of the buckets that can be filled."""
    return list(C.BUCKETS)


def request_paraphrases(spark: SparkSession, shard_dir: str, seed_files: list[str], out_dir: str,
                        buckets: list[str] | None = None, target: int = C.TARGET_PER_BUCKET,
                        factor: int = C.OVERSAMPLE_FACTOR) -> DataFrame:
    """Write the requests that are needed to fill the buckets and return the
    needs.  Where the responses turn out to hold too many duplicates, a later
    call asks for what is still missing, by the rows that are in the shards."""
    ensure_checkpoint_dir(spark)
    needs = written(B.fill_needs(spark, ST.read_shards(spark, shard_dir), target, buckets), "needs")
    pool = SD.read_seed_lines(spark, seed_files).select("seed")
    K.write_jsonl(B.paraphrase_requests(needs, pool, factor), out_dir)
    return needs.select("bucket", "existing", "need")


def fill_buckets(spark: SparkSession, responses: str, shard_dir: str, state_dir: str, target: int = C.TARGET_PER_BUCKET) -> DataFrame:
    """Append the responses (JSON lines of ``node, bucket, text, seed``) that
    are no near-duplicates, up to each bucket's need; a second call takes only
    files that are new.  Returns the shards' sizes."""
    ensure_checkpoint_dir(spark)
    stream = spark.readStream.schema("node long, bucket string, text string, seed string").json(responses)
    ST.start_fill(spark, stream, shard_dir, f"{state_dir}/bands", f"{state_dir}/checkpoint", target).awaitTermination()
    return B.bucket_sizes(ST.read_shards(spark, shard_dir))


REFILL_STATE = "bucket string, existing long, need long"


def refill(spark: SparkSession, shard_dir: str, seed_files: list[str], work_dir: str, answer: Callable[[DataFrame, int], DataFrame],
           buckets: list[str] | None = None, target: int = C.TARGET_PER_BUCKET, factor: int = C.OVERSAMPLE_FACTOR, max_rounds: int = 50) -> DataFrame:
    """M-3 / D-5 to the end: request, answer, deduplicate and append, and ask again
    with other seeds for what is missing, until every bucket has its target or a
    round adds nothing.  ``answer`` turns requests (bucket, request_no, seed,
    system_prompt) into responses (bucket, request_no, seed, text).

    The needs at the start of each round are a version of the table
    ``work_dir/state``.  A call after a crash goes on in the round of the last
    version: requests and responses that are complete are used again, and the
    fill goes on from its checkpoint.  Returns the last needs."""
    ensure_checkpoint_dir(spark)
    state = VersionedTable(spark, f"{work_dir}/state", REFILL_STATE)

    def needs() -> DataFrame:
        return B.fill_needs(spark, ST.read_shards(spark, shard_dir), target, buckets)

    def kept(name: str, make) -> DataFrame:
        path = f"{work_dir}/{name}"
        if not ST._exists(spark, f"{path}/_SUCCESS"):
            K.write_jsonl(make(), path)
        return spark.read.schema("bucket string, request_no long, seed string, system_prompt string, text string").json(path)

    if not state.versions():
        state.write(needs(), after=0)
    while True:
        number = state.versions()[-1]
        start = {r["bucket"]: r["existing"] for r in state.read(number).filter("need > 0").collect()}  # at most 20 buckets
        before = {r["bucket"]: r["existing"] for r in state.read(number - 1).collect()} if number > 1 else {}
        if not start or number > max_rounds or start and all(before.get(b) == n for b, n in start.items()):
            return state.read(number)
        # the need of the version, also where a fill that crashed has met a part of it
        open_ = needs().drop("existing", "need").join(F.broadcast(state.read(number)), "bucket")
        pool = SD.read_seed_lines(spark, seed_files).select("seed")
        requests = kept(f"requests/r{number:05d}", lambda: B.paraphrase_requests(open_, pool, factor, draw=number))
        place = F.array_position(F.array(*[F.lit(b) for b in C.BUCKETS]), F.col("bucket"))
        node = F.lit(number) * F.lit(1 << 45) + place * F.lit(1 << 38) + F.col("request_no")
        kept(f"responses/r{number:05d}", lambda: answer(requests.drop("text"), number).select(node.cast("long").alias("node"), "bucket", "request_no", "seed", "text"))
        stream = spark.readStream.schema("node long, bucket string, text string, seed string").json(f"{work_dir}/responses/*")
        ST.start_fill(spark, stream, shard_dir, f"{work_dir}/bands", f"{work_dir}/checkpoint", target).awaitTermination()
        state.write(needs(), after=number)


def list_available(spark: SparkSession, prompt_dir: str) -> DataFrame:
    """Buckets that have a shard of prompts, with their sizes."""
    rows = spark.read.schema("prompt string, completion string, bucket string").json(prompt_dir)
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows")).orderBy("bucket")


def plan_training(spark: SparkSession, prompt_dir: str, registry_dir: str, names: list[str] | None = None,
                  all_poles: bool = False, force_retrain: bool = False, now: float | None = None) -> DataFrame:
    """Plan the runs of the named buckets, of all poles, or of every shard there
    is; write the registry and return the plan, with a row for each requested
    bucket that has no shard (``missing``).  The registry is a versioned table: a
    run that dies leaves the version before, and of two runs at once the second fails."""
    ensure_checkpoint_dir(spark)
    rows = spark.read.schema("prompt string, completion string, bucket string").json(prompt_dir)
    current = written(RG.shard_fingerprints(rows), "fingerprints")
    if names or all_poles:
        requested = RG.requested_buckets(spark, names, all_poles)
        missing = requested.join(current, "bucket", "left_anti")
        current = current.join(requested, "bucket", "left_semi")
    else:
        missing = current.limit(0).select("bucket")
    table = VersionedTable(spark, registry_dir, REGISTRY_SCHEMA)
    versions = table.versions()
    registry = table.read()
    plan = written(RG.run_plan(current, registry, force_retrain), "run-plan")
    after = RG.registry_upsert(registry.limit(0) if force_retrain else registry, plan, time.time() if now is None else now)
    status = registry.select("hash", F.col("job_id").alias("_job"), "status")
    after = after.join(status, (after["hash"] == status["hash"]) & (after["job_id"] == status["_job"]), "left").select(after["*"], "status")
    table.write(after, after=versions[-1] if versions else 0)
    return plan.select("bucket", "file_name", "n_rows", "hash", "action", "job_id").unionByName(
        missing.select("bucket", F.lit("missing").alias("action")), allowMissingColumns=True)


def read_registry(spark: SparkSession, registry_dir: str, version: int | None = None) -> DataFrame:
    """The registry as ``plan_training`` left it, or an earlier version of it."""
    return VersionedTable(spark, registry_dir, REGISTRY_SCHEMA).read(version)


def unfinished(requested: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """J-6: requested buckets without a finished checkpoint (``bucket, finished``)."""
    return requested.join(checkpoints.filter("finished").select("bucket"), "bucket", "left_anti")


def registry_audit(registry: DataFrame, job_ids: DataFrame) -> DataFrame:
    """R-6: traits whose job differs between the registry and the job-id table,
    that only one of them has, or that the registry holds more than once."""
    mine = registry.groupBy("trait").agg(F.count(F.lit(1)).alias("entries"), F.max_by("job_id", "created_at").alias("registry_job"))
    theirs = job_ids.select("trait", F.col("job_id").alias("listed_job"))
    both = mine.join(theirs, "trait", "full_outer")
    finding = (F.when(F.col("registry_job").isNull(), F.lit("not_in_registry"))
               .when(F.col("listed_job").isNull(), F.lit("not_listed"))
               .when(F.col("registry_job") != F.col("listed_job"), F.lit("different_job"))
               .when(F.col("entries") > 1, F.lit("duplicate")))
    return both.withColumn("finding", finding).filter(F.col("finding").isNotNull())
