"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver's test tables (or data Spark derives from them)
and runs over whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import jobs as J
from ..functions import constants as C
from ..functions import text as X
from ..functions.plan import evenly
from ..operators import dedup as D
from ..operators import exact as EX
from ..operators import label as L
from ..operators import seeds as SD
from ..operators import shards as B
from ..operators import registry as RG
from ..operators import report as R
from ..operators import vectors as V
from ..operators import sample as S
from ..session import scratch_path, stored
from ..sinks import writers as K
from ..sinks.versioned import VersionedTable
from ..sources import adapters as A
from ..sources import files as FS
from ..streaming import fill as ST
from ..streaming import jobs_log as JL
from ..sources import mapping as M

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source row with its reason, labelled and classified once per
    session and version of the tables; the queries below read it."""
    return stored(spark, sf_dir, "classified", ["conversations", "documents", "embeddings"], L.classified)


def corpus_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows without a reason, written once like ``classified``, of which they are a small part."""
    return stored(spark, sf_dir, "corpus", ["conversations", "documents", "embeddings"], L.corpus_rows)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balanced corpus: labelled -> kept -> stratified sample."""
    return S.stratified_sample(corpus_raw(spark, sf_dir))


# ----------------------------------------------------------- labelling ---

def _source(name: str) -> Query:
    def q(spark, sf_dir):
        return classified(spark, sf_dir).filter(F.col("source") == name)
    return q


register("label_roles")(_source("EmpatheticDialogues"))
register("label_dialogue_arrays")(_source("DailyDialog"))
register("label_int")(_source("EmotionLines"))
register("label_string")(_source("MELD"))
register("label_activations")(_source("IEMOCAP"))


@register("role_first_speaker")
def role_first_speaker(spark, sf_dir):
    conv = A.table(spark, sf_dir, "conversations")
    return L.first_speakers(A.roles_from_conversations(conv), M.emotion_dim(spark))


@register("skip_funnel")
def skip_funnel(spark, sf_dir):
    return R.skip_funnel(classified(spark, sf_dir))


@register("corpus_union")
def corpus_union(spark, sf_dir):
    return corpus_raw(spark, sf_dir)


@register("corpus_sampled")
def corpus_sampled(spark, sf_dir):
    return corpus(spark, sf_dir)


@register("sampling_reduction")
def sampling_reduction(spark, sf_dir):
    return R.reduction_summary(corpus_raw(spark, sf_dir), S.keep())


@register("sampling_strata_counts")
def sampling_strata_counts(spark, sf_dir):
    return R.before_and_after(corpus_raw(spark, sf_dir).filter(R.sampled_strata()), ["source", "original_tag"], S.keep())


@register("source_distribution")
def source_distribution(spark, sf_dir):
    return R.before_and_after(corpus_raw(spark, sf_dir), ["source"], S.keep())


@register("source_stats")
def source_stats(spark, sf_dir):
    return R.source_stats(corpus(spark, sf_dir))


@register("trait_polarity")
def trait_polarity(spark, sf_dir):
    return R.trait_polarity(corpus(spark, sf_dir))


@register("top_tags")
def top_tags(spark, sf_dir):
    return R.top_tags(corpus(spark, sf_dir))


@register("quality_issues")
def quality_issues(spark, sf_dir):
    return R.quality_issues(corpus(spark, sf_dir))


@register("label_frequency")
def label_frequency(spark, sf_dir):
    """A-1: label frequency per source, before any filter."""
    c = classified(spark, sf_dir).filter(F.col("label").isNotNull())
    return c.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n")).orderBy("source", F.desc("n"), "label")


@register("unmapped_labels")
def unmapped_labels(spark, sf_dir):
    """J-3: distinct labels missing from the mapping, with their counts."""
    c = classified(spark, sf_dir).filter(F.col("reason") == "unmapped")
    return c.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))


@register("utterance_quality")
def utterance_quality(spark, sf_dir):
    """Q-1..Q-6 over every document, first failing reason (or meaningful)."""
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "text")
    return L.utterance_reasons(docs, "text").drop("text")


@register("quality_edges")
def quality_edges(spark, sf_dir):
    """Q-1..Q-6 and Q-0 over edge texts made from every document, so that each reason occurs."""
    docs = A.table(spark, sf_dir, "documents").select("doc_id", A.edge_text("doc_id", "text").alias("text"))
    return L.utterance_reasons(docs, "text").select("doc_id", "reason")


@register("origin_counts")
def origin_counts(spark, sf_dir):
    """A-3: distinct origin ids per source among processed rows."""
    return corpus_raw(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("processed"), F.count_distinct("origin_id").alias("unique_origins"))


# --------------------------------------------------------------- seeds ---

def _classify_seeds(spark, sf_dir):
    conv = A.table(spark, sf_dir, "conversations")
    return SD.classify_seeds(A.seeds_from_conversations(conv))


def _seed_classified(spark, sf_dir):
    return stored(spark, sf_dir, "seeds", ["conversations"], _classify_seeds)


def seed_pool(spark, sf_dir):
    """The seed pool: every accepted seed inside the loader's word window (Q-14)."""
    seeds = SD.seed_rows(_seed_classified(spark, sf_dir))
    n = F.col("word_count")
    return seeds.filter((n > C.LOADER_MIN_WORDS_EXCL) & (n < C.LOADER_MAX_WORDS_EXCL)).select(
        F.col("utterance").alias("seed"))


@register("seed_quality")
def seed_quality(spark, sf_dir):
    return _seed_classified(spark, sf_dir)


@register("seed_edges")
def seed_edges(spark, sf_dir):
    """Q-11..Q-13 over edge texts made from every conversation row, with ``min_words`` 1."""
    conv = A.table(spark, sf_dir, "conversations")
    src = A.seeds_from_conversations(conv).withColumn("text", A.edge_seed("turn", "conv_id", "text"))
    return SD.classify_seeds(src, min_words=1).select("conv_id", "turn", "cleaned", "seed_reason")


@register("seed_skip_reasons")
def seed_skip_reasons(spark, sf_dir):
    return SD.skip_reasons(_seed_classified(spark, sf_dir))


@register("seed_emotions")
def seed_emotions(spark, sf_dir):
    return SD.emotion_distribution(_seed_classified(spark, sf_dir))


@register("seed_top_n")
def seed_top_n(spark, sf_dir):
    return SD.first_seeds(_seed_classified(spark, sf_dir))


# ------------------------------------------------------ shards, prompts ---

def _bucket_rows(spark, sf_dir):
    return B.bucket_rows(corpus(spark, sf_dir))


@register("bucket_rows")
def bucket_rows(spark, sf_dir):
    return _bucket_rows(spark, sf_dir).select("bucket", "source", "origin_id", *C.TRAIT_COLUMNS)


@register("bucket_sizes")
def bucket_sizes(spark, sf_dir):
    return B.bucket_sizes(_bucket_rows(spark, sf_dir))


@register("prompt_rows")
def prompt_rows(spark, sf_dir):
    return B.prompt_rows(corpus(spark, sf_dir)).select("source", "origin_id", "prompt", "completion")


@register("converted_counts")
def converted_counts(spark, sf_dir):
    return B.converted_counts(B.prompt_rows(_bucket_rows(spark, sf_dir)))


@register("paraphrase_requests")
def paraphrase_requests(spark, sf_dir):
    needs = B.fill_needs(spark, _bucket_rows(spark, sf_dir))
    return B.paraphrase_requests(needs, seed_pool(spark, sf_dir))


FEW_TARGET = 10


@register("paraphrase_requests_few")
def paraphrase_requests_few(spark, sf_dir):
    """N-1 with a target so low that seeds are drawn without replacement (M-2)."""
    needs = B.fill_needs(spark, _bucket_rows(spark, sf_dir), FEW_TARGET)
    return B.paraphrase_requests(needs, seed_pool(spark, sf_dir))


@register("bucket_needs")
def bucket_needs(spark, sf_dir):
    return B.fill_needs(spark, _bucket_rows(spark, sf_dir)).select("bucket", "existing", "need")


# ------------------------------------------------------ near-duplicates ---

def _build_members(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "text")
    return D.document_members(evenly(docs))


def _doc_members(spark, sf_dir):
    return stored(spark, sf_dir, "members", ["documents"], _build_members)


@register("minhash_bands")
def minhash_bands(spark, sf_dir):
    return _doc_members(spark, sf_dir).select(F.col("node").alias("doc_id"), "band", "band_key")


@register("near_dup_first")
def near_dup_first(spark, sf_dir):
    return D.earliest_partner(_doc_members(spark, sf_dir)).select(
        F.col("node").alias("doc_id"), "earliest_partner")


@register("greedy_dedup")
def greedy_dedup(spark, sf_dir):
    verdict = D.greedy_accept(_doc_members(spark, sf_dir))
    return verdict.select(F.col("node").alias("doc_id"), "accepted")


def _build_sets(spark, sf_dir):
    return EX.shingle_sets(A.table(spark, sf_dir, "documents").select("doc_id", "text"))


def _shingle_sets(spark, sf_dir):
    return stored(spark, sf_dir, "shingle-sets", ["documents"], _build_sets)


def _build_links(spark, sf_dir):
    return EX.links(_shingle_sets(spark, sf_dir))


def _class_links(spark, sf_dir):
    return stored(spark, sf_dir, "class-links", ["documents"], _build_links)


@register("near_dup_classes")
def near_dup_classes(spark, sf_dir):
    """D-6: the class of each document, all documents of one shingle set."""
    return EX.classes(_shingle_sets(spark, sf_dir)).select(F.col("node").alias("doc_id"), "class_id", "class_size", F.col("n").alias("n_shingles"))


@register("near_dup_links")
def near_dup_links(spark, sf_dir):
    """D-6: exact links at the threshold, between class representatives."""
    return _class_links(spark, sf_dir)


@register("near_dup_verified")
def near_dup_verified(spark, sf_dir):
    """D-3: every pair of documents that share a band, with its exact similarity."""
    return EX.verified(_doc_members(spark, sf_dir), _shingle_sets(spark, sf_dir)).withColumnRenamed("node", "doc_id")


@register("lsh_quality")
def lsh_quality(spark, sf_dir):
    """False positives of the bands, and their recall of the exact links."""
    checked = EX.verified_representatives(_doc_members(spark, sf_dir), _shingle_sets(spark, sf_dir))
    return EX.band_quality(_doc_members(spark, sf_dir), checked, _class_links(spark, sf_dir))


def _candidates(spark, sf_dir):
    """Documents stand in for paraphrase responses: bucket by doc_id, the
    original seed by id."""
    buckets = F.array(*[F.lit(b) for b in C.BUCKETS])
    return A.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("node"),
        F.element_at(buckets, (F.pmod(F.col("doc_id"), F.lit(len(C.BUCKETS))) + 1).cast("int")).alias("bucket"),
        F.col("text"),
        F.concat(F.lit("seed "), F.col("doc_id").cast("string")).alias("seed"),
    )


@register("fill_to_target")
def fill_to_target(spark, sf_dir):
    """D-5 + N-2: responses deduplicated per bucket against the existing shard
    rows and appended up to each bucket's need."""
    rows = _bucket_rows(spark, sf_dir)
    needs = B.fill_needs(spark, rows).select("bucket", "need")
    existing = rows.select("bucket", F.col("utterance").alias("text"))
    return K.flat_synthetic(B.synthetic_rows(D.fill_to_target(_candidates(spark, sf_dir), existing, needs)))


# ------------------------------------------------------------ registry ---

PLAN_NOW = 1.76e9
REFERENCE_ADAPTER = "adapter_0"


def _fingerprints(corpus_df):
    return RG.shard_fingerprints(B.prompt_rows(B.bucket_rows(corpus_df)))


def _registry(spark, sf_dir):
    """The previous run's registry: it saw the same shards, but for those of a
    fifth of the buckets, which had the unsampled rows then."""
    changed = F.pmod(RG.hash32(F.col("bucket"), salt="changed"), F.lit(5)) == 0
    before = _fingerprints(corpus_raw(spark, sf_dir)).filter(changed)
    return RG.registry_from_run(_fingerprints(corpus(spark, sf_dir)).filter(~changed).unionByName(before))


@register("shard_fingerprints")
def shard_fingerprints(spark, sf_dir):
    return _fingerprints(corpus(spark, sf_dir))


@register("run_plan")
def run_plan(spark, sf_dir):
    return RG.run_plan(_fingerprints(corpus(spark, sf_dir)), _registry(spark, sf_dir))


@register("registry_upsert")
def registry_upsert(spark, sf_dir):
    registry = _registry(spark, sf_dir)
    plan = RG.run_plan(_fingerprints(corpus(spark, sf_dir)), registry)
    return RG.registry_upsert(registry, plan, PLAN_NOW)


@register("job_terminal_status")
def job_terminal_status(spark, sf_dir):
    return RG.terminal_status(RG.job_status_log(A.table(spark, sf_dir, "events")))


#: Parts that the job log of ``job_status_stream`` arrives in, and after how many the stream is started again.
LOG_PARTS = 4
LOG_RESTART = 2


@register("job_status_stream")
def job_status_stream(spark, sf_dir):
    """R-5 on an arriving log: events come in parts that do not follow their
    order, the stream is started twice, and the states are those of one pass."""
    base = scratch_path(spark, "job-log")
    log = RG.job_status_log(A.table(spark, sf_dir, "events")).select("job_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), "status")
    part = F.pmod(F.hash("event_id"), F.lit(LOG_PARTS))
    for i in range(LOG_PARTS):
        log.filter(part == i).write.mode("append").parquet(f"{base}/incoming")
        if i + 1 in (LOG_RESTART, LOG_PARTS):
            # all files that are there in one batch: nearly every job has events in each, and batches of so many files would grow with the input
            stream = spark.readStream.schema(log.schema).parquet(f"{base}/incoming")
            JL.start_following(stream, f"{base}/states", f"{base}/checkpoint").awaitTermination()
    return JL.job_states(spark, f"{base}/states").drop("silent")


REGISTRY_ROWS = "hash string, job_id string, file_name string, trait string, created_at double"


@register("registry_versions")
def registry_versions(spark, sf_dir):
    """R-3 / K-8: the registry before and after a run as versions of one table, rows of both."""
    table = VersionedTable(spark, scratch_path(spark, "registry"), REGISTRY_ROWS)
    first = table.write(_registry(spark, sf_dir))
    plan = RG.run_plan(_fingerprints(corpus(spark, sf_dir)), _registry(spark, sf_dir))
    second = table.write(RG.registry_upsert(table.read(first), plan, PLAN_NOW), after=first)
    return table.read(first).withColumn("version", F.lit(first)).unionByName(table.read(second).withColumn("version", F.lit(second)))


@register("coverage_audit")
def coverage_audit(spark, sf_dir):
    available = B.bucket_sizes(_bucket_rows(spark, sf_dir)).select("bucket", F.col("n").alias("n_rows"))
    return RG.coverage_audit(RG.requested_buckets(spark, all_poles=True), available)


# ------------------------------------------------------------- vectors ---

def _adapter_names(spark, sf_dir):
    return _bucket_rows(spark, sf_dir).select(F.col("bucket").alias("name")).distinct()


@register("trait_vectors")
def trait_vectors(spark, sf_dir):
    return V.vector_table(_adapter_names(spark, sf_dir))


@register("trait_vectors_lenient")
def trait_vectors_lenient(spark, sf_dir):
    return V.lenient_table(_adapter_names(spark, sf_dir))


@register("trait_vector_audit")
def trait_vector_audit(spark, sf_dir):
    return V.vector_audit(V.lenient_table(_adapter_names(spark, sf_dir)))


def _emb(spark, sf_dir):
    return A.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


@register("vector_stats")
def vector_stats(spark, sf_dir):
    return V.vector_stats(_emb(spark, sf_dir))


@register("vector_validity")
def vector_validity(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    return V.validity(V.vector_stats(emb), expected=emb.count())


@register("vector_dup_signature")
def vector_dup_signature(spark, sf_dir):
    return V.duplicate_signatures(_emb(spark, sf_dir))


@register("vector_dup_copies")
def vector_dup_copies(spark, sf_dir):
    """X-10 where duplicates occur: every tenth vector comes twice."""
    emb = _emb(spark, sf_dir)
    again = emb.filter(F.pmod("vec_id", F.lit(10)) == 0).withColumn("vec_id", F.col("vec_id") + 1_000_000_000)
    return V.duplicate_signatures(emb.unionByName(again))


@register("cosine_triplets")
def cosine_triplets(spark, sf_dir):
    return V.triplets(_emb(spark, sf_dir))


@register("vector_global")
def vector_global(spark, sf_dir):
    return V.global_distribution(_emb(spark, sf_dir))


@register("vector_fit")
def vector_fit(spark, sf_dir):
    return V.fitted(_emb(spark, sf_dir))


def _tensors(spark, sf_dir):
    return V.adapter_tensors(_emb(spark, sf_dir))


@register("adapter_flatten")
def adapter_flatten(spark, sf_dir):
    return V.flatten_adapters(_tensors(spark, sf_dir), REFERENCE_ADAPTER)[1]


@register("adapter_flat_values")
def adapter_flat_values(spark, sf_dir):
    return V.flatten_adapters(_tensors(spark, sf_dir), REFERENCE_ADAPTER)[0]


@register("vector_norms")
def vector_norms(spark, sf_dir):
    return V.weight_norms(V.adapter_blocks(_emb(spark, sf_dir)), REFERENCE_ADAPTER)


@register("vector_blend")
def vector_blend(spark, sf_dir):
    t = V.adapter_blocks(_emb(spark, sf_dir))
    weights = t.select("adapter").distinct().withColumn("weight", F.lit(C.ADAPTER_BLEND_WEIGHT))
    return V.blend(t, weights)


# ------------------------------------------------- files, sinks, streams ---

@register("corpus_export_roundtrip")
def corpus_export_roundtrip(spark, sf_dir):
    """K-3 + S-8: export the corpus as nested JSONL to the shared folder and
    read it back with the fixed schema (strict mode)."""
    path = scratch_path(spark, "corpus-jsonl")
    K.export_corpus(corpus(spark, sf_dir), path, "jsonl")
    return K.flat(FS.read_corpus_jsonl(spark, path, strict=True))


@register("corpus_json_array")
def corpus_json_array(spark, sf_dir):
    """K-4: export the corpus as one JSON array in parts and read it back."""
    path = scratch_path(spark, "corpus-json")
    K.export_corpus(corpus(spark, sf_dir), path, "json")
    return K.flat(K.read_json_array(spark, path))


@register("split_rows")
def split_rows(spark, sf_dir):
    """S-11: conversations laid out by split; one split is read, by its partition."""
    path = scratch_path(spark, "splits")
    n = F.pmod(F.col("conv_id"), F.lit(10))
    split = F.when(n < 8, F.lit("train")).when(n == 8, F.lit("validation")).otherwise(F.lit("test"))
    K.write_splits(A.table(spark, sf_dir, "conversations").withColumn("split", split), path)
    return A.select_split(spark.read.parquet(path), "validation").select("conv_id", "turn", "role", "text", "split")


@register("corpus_file_roundtrips")
def corpus_file_roundtrips(spark, sf_dir):
    """K-1 and K-2: the corpus as Parquet and as CSV, read back; a row for each format and row."""
    base, rows = scratch_path(spark, "corpus-files"), corpus(spark, sf_dir)
    K.export_corpus(rows, f"{base}/parquet", "parquet")
    K.export_corpus(rows, f"{base}/csv", "csv")
    parts = {"parquet": spark.read.parquet(f"{base}/parquet"), "csv": K.read_csv_corpus(spark, f"{base}/csv", rows.schema)}
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("format", F.lit(k)) for k, df in parts.items()])


@register("seed_file_scan")
def seed_file_scan(spark, sf_dir):
    """K-7 + S-7 + W-3 + Q-14: write the accepted seeds as JSONL and as plain
    text lines, then load them back (first 5000 lines per file; no file is
    written with more, so every seed comes back)."""
    seeds = SD.seed_rows(_seed_classified(spark, sf_dir))
    base = scratch_path(spark, "seeds")
    K.write_jsonl(seeds.drop("conv_id", "turn"), f"{base}/jsonl", max_per_file=C.LOADER_MAX_LINES_PER_FILE)
    seeds.select("utterance").write.option("maxRecordsPerFile", C.LOADER_MAX_LINES_PER_FILE).text(f"{base}/text")
    return SD.read_seed_lines(spark, [f"{base}/jsonl", f"{base}/text"]).select("seed")


@register("artifact_audit")
def artifact_audit(spark, sf_dir):
    """S-10 over header-bearing artifacts written from the vectors, one small
    file per 1024 ids; every fifth declares more bytes than it has."""
    path = scratch_path(spark, "artifacts")
    FS.write_artifacts(_emb(spark, sf_dir), path)
    audit = FS.artifact_audit(spark, f"{path}/artifact=*/*.txt")
    return audit.select(F.regexp_extract("path", r"artifact=([^/]+)/", 1).cast("long").alias("artifact"), "size", "header_len", "corrupt")


@register("adapter_json_ingest")
def adapter_json_ingest(spark, sf_dir):
    """S-9: write adapter weight documents (tensors as plain lists or as
    {data, shape, dtype} dicts) and ingest them back to the long table.
    Grouping is per adapter over its architecture-sized tensor set."""
    t = V.adapter_tensors(_emb(spark, sf_dir))
    per_tensor = t.groupBy("adapter", "tensor_key").agg(
        F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("pv"))
    vals = F.transform("pv", lambda x: x["value"])
    entry = F.when(F.col("tensor_key").endswith("lora_A"), F.to_json(vals)).otherwise(
        F.to_json(F.struct(vals.alias("data"), F.array(F.size("pv").cast("long")).alias("shape"),
                           F.lit("float32").alias("dtype"))))
    docs = per_tensor.groupBy("adapter").agg(
        F.map_from_entries(F.collect_list(F.struct("tensor_key", entry.alias("entry")))).alias("entries"))
    path = scratch_path(spark, "adapters")
    docs.select(F.to_json(F.struct(
        F.create_map(F.lit("name"), F.col("adapter")).alias("metadata"),
        F.col("entries").alias("state_dict"))).alias("value")).write.text(path)
    return FS.read_adapter_json(spark, path, multi_line=False)


def _build_adapter_files(spark, sf_dir):
    """Adapter documents from the vectors, eight tensors each: plain lists, dicts
    with ``data`` or ``values``, flat or two-dimensional, in three types; values
    of all magnitudes and exact ties; every seventh adapter has a tensor whose
    shape is wrong, every third brings configuration of its own."""
    k = F.pmod("vec_id", F.lit(8)).cast("int")
    adapter = F.floor(F.col("vec_id") / 8).cast("long")
    sized = lambda x, n: 1 + (F.pmod(F.floor(F.abs(x) * 4096), F.lit(n)) + 0.5) / n

    def value(x, i):
        x = x.cast("double")
        return (F.when(i == 61, x * 1e-39).when(i == 62, F.signum(x) * 3.4e38)
                .when(i % 5 == 1, x * 1e-6).when(i % 5 == 2, x * 1e6).when(i % 5 == 3, sized(x, 1024)).when(i % 5 == 4, sized(x, 128)).otherwise(x))

    emb = _emb(spark, sf_dir).select("vec_id", adapter.alias("a"), k.alias("k"), F.transform("embedding", value).alias("v"))
    n = F.size("v")
    wrong = (F.col("a") % 7 == 0) & (F.col("k") == 4)
    shape = F.array((n + F.when(wrong, 1).otherwise(0)).cast("long"))
    two_d = F.array(F.slice("v", F.lit(1), F.floor(n / 2).cast("int")), F.slice("v", F.floor(n / 2).cast("int") + 1, F.floor(n / 2).cast("int")))
    dtype = F.when(F.col("k").isin(2, 3), "float16").when(F.col("k").isin(4, 5), "bfloat16").otherwise("float32")
    entry = (F.when(F.col("k") < 2, F.to_json("v"))
             .when(F.col("k") < 6, F.to_json(F.struct(F.col("v").alias("data"), shape.alias("shape"), dtype.alias("dtype"))))
             .when(F.col("k") == 6, F.to_json(F.struct(two_d.alias("values"), F.array(F.lit(2), F.floor(n / 2)).alias("shape"))))
             .otherwise(F.to_json(F.struct(F.col("v").alias("data")))))
    key = F.concat(F.lit("t"), F.col("k").cast("string"))
    docs = emb.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct(key, entry.alias("entry")))).alias("state_dict"))
    name = F.concat(F.lit("adapter_"), F.col("a").cast("string"))
    metadata = F.when(F.col("a") % 3 == 0, F.create_map(F.lit("name"), name, F.lit("peft_type"), F.lit("OTHER"), F.lit("rank"), F.col("a").cast("string"))) \
        .otherwise(F.create_map(F.lit("name"), name))
    return docs.select(F.to_json(F.struct(metadata.alias("metadata"), "state_dict")).alias("value"))


def _adapter_files(spark, sf_dir):
    path = scratch_path(spark, "adapter-files")
    stored(spark, sf_dir, "adapter-files", ["embeddings"], _build_adapter_files).write.text(path)
    return path


@register("adapter_half_ingest")
def adapter_half_ingest(spark, sf_dir):
    """S-9: values as their tensor types hold them; ``infinite`` is the sign of those that overflow."""
    t = FS.read_adapter_json(spark, _adapter_files(spark, sf_dir), multi_line=False)
    inf = F.abs("value") == float("inf")
    return t.select("adapter", "tensor_key", "pos", "dtype", F.when(~inf, F.col("value")).alias("value"), F.when(inf, F.signum("value")).otherwise(0.0).cast("int").alias("infinite"))


@register("adapter_tensor_audit")
def adapter_tensor_audit(spark, sf_dir):
    """S-9: each tensor's values against its declared shape."""
    t = FS.read_adapter_tensors(spark, _adapter_files(spark, sf_dir), multi_line=False)
    return t.select("adapter", "tensor_key", "dtype", F.size("values").cast("long").alias("n"), F.coalesce(F.size("shape"), F.lit(0)).cast("int").alias("dims"), "shape_ok")


@register("adapter_configs")
def adapter_configs(spark, sf_dir):
    """S-9: metadata with the defaults merged in."""
    c = FS.read_adapter_configs(spark, _adapter_files(spark, sf_dir), multi_line=False)
    return c.select("adapter", *[F.col("config")[k].alias(k) for k in [*C.ADAPTER_DEFAULTS, "rank"]], F.size("config").cast("long").alias("n_keys"))


#: Parts that the responses of ``fill_stream`` arrive in.
FILL_BATCHES = 4


@register("fill_stream")
def fill_stream(spark, sf_dir):
    """D-5 micro-batch form: responses arrive as a file stream and fill empty
    buckets through ``foreachBatch``.  They come in ``FILL_BATCHES`` parts by
    ranges of node, each a micro-batch after the one before, so the result is
    that of one pass in candidate order."""
    base = scratch_path(spark, "fill-stream")
    cand = _candidates(spark, sf_dir)
    cuts = cand.approxQuantile("node", [i / FILL_BATCHES for i in range(1, FILL_BATCHES)], 0.01)
    part = sum((F.when(F.col("node") > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    for i in range(FILL_BATCHES):
        cand.filter(part == i).write.mode("append").parquet(f"{base}/incoming")
        stream = spark.readStream.schema(cand.schema).parquet(f"{base}/incoming")
        q = ST.start_fill(spark, stream, f"{base}/shards", f"{base}/bands", f"{base}/checkpoint")
        q.awaitTermination()
    return K.flat_synthetic(ST.read_shards(spark, f"{base}/shards"))


#: Rows that ``refill_rounds`` fills the buckets up to, and the share of the need that a round's answers differ in.
REFILL_TARGET = 200
REFILL_SHARE = 0.9


@register("refill_rounds")
def refill_rounds(spark, sf_dir):
    """M-3 / D-5: the corpus' shards are filled up in as many rounds as it takes;
    the answers of a round are nine different texts for every ten rows that are
    missing, so one round is not enough."""
    base = scratch_path(spark, "refill")
    K.write_shards(K.nested(_bucket_rows(spark, sf_dir), "bucket"), f"{base}/shards")
    seed_pool(spark, sf_dir).select("seed").write.option("maxRecordsPerFile", C.LOADER_MAX_LINES_PER_FILE).text(f"{base}/seeds")

    def answer(requests, number):
        most = F.max("request_no").over(Window.partitionBy("bucket")) + 1  # requests of a bucket: bounded by the target
        which = F.pmod(F.col("request_no"), F.greatest(F.ceil(most / C.OVERSAMPLE_FACTOR * REFILL_SHARE), F.lit(1)))
        name = F.md5(F.concat_ws("|", "bucket", F.lit(number), which.cast("string")))
        words = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("w"), F.substring(F.md5(F.concat(name, i.cast("string"))), 1, 10)))
        return requests.withColumn("text", F.array_join(words, " "))

    J.refill(spark, f"{base}/shards", [f"{base}/seeds"], f"{base}/work", answer, target=REFILL_TARGET)
    return B.fill_needs(spark, ST.read_shards(spark, f"{base}/shards"), REFILL_TARGET).select("bucket", "existing", "need")


@register("label_dialogue_lists")
def label_dialogue_lists(spark, sf_dir):
    """P-1 + P-2 + L-3 over array dialogues, some without emotions."""
    arrays = A.dialogue_arrays_from_conversations(A.table(spark, sf_dir, "conversations"))
    return L.label_dialogue(A.explode_dialogue(arrays), M.numeric_dim(spark))


@register("shard_export")
def shard_export(spark, sf_dir):
    """K-5 + B-2: write every bucket's nested rows as one shard directory per
    bucket (overwrite), read the shards back and report each shard's size
    and whether it meets the minimum for training."""
    rows = _bucket_rows(spark, sf_dir)
    path = scratch_path(spark, "shards")
    K.write_shards(K.nested(rows, "bucket"), path)
    back = spark.read.json(path)
    return B.bucket_sizes(back)

