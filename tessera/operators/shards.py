"""B-1..B-5, Q-15, Q-16, A-12, A-13, N-1..N-3, P-11, M-2, M-3, J-4, J-7."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..sources import mapping as M
from ..session import written
from .sample import hash32

#: Ranges of the seed pool's hash order.
POOL_RANGE_BITS = 12


def pole_array() -> Column:
    """B-1 / Q-15: the buckets a row belongs to (0..10 of them)."""
    poles = [
        F.when(F.col(f"trait_{t}") >= C.POLE_HIGH, F.lit(f"{t}_plus"))
        .when(F.col(f"trait_{t}") <= C.POLE_LOW, F.lit(f"{t}_minus"))
        for t in C.TRAITS
    ]
    return F.filter(F.array(*poles), lambda b: b.isNotNull())


def bucket_rows(corpus: DataFrame) -> DataFrame:
    """B-1: multi-assign each corpus row to its trait-pole buckets.  Rows in
    no bucket are filtered before the explode, so they never expand."""
    return (corpus.withColumn("buckets", pole_array())
            .filter(F.size("buckets") > 0)
            .withColumn("bucket", F.explode("buckets")).drop("buckets"))


def bucket_sizes(rows: DataFrame, min_rows: int = C.MIN_PER_BUCKET) -> DataFrame:
    """A-12 / B-2: rows per bucket and whether the bucket is large enough."""
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "kept", F.col("n") >= min_rows)


def kept_bucket_rows(rows: DataFrame, min_rows: int = C.MIN_PER_BUCKET) -> DataFrame:
    """B-2: rows of buckets at or above the minimum.  The size table has at
    most 20 rows, so broadcasting it is bounded."""
    ok = bucket_sizes(rows, min_rows).filter("kept").select("bucket")
    return rows.join(F.broadcast(ok), "bucket", "left_semi")


def descriptions() -> list[Column]:
    """B-3 / Q-16: per trait, the positive or negative description."""
    out = []
    for t in C.TRAITS:
        pos, neg = C.TRAIT_DESCRIPTIONS[t]
        v = F.col(f"trait_{t}")
        out.append(F.when(v > C.DESCRIPTION_HIGH, F.lit(pos)).when(v < C.DESCRIPTION_LOW, F.lit(neg)))
    return out


def prompt() -> Column:
    """B-4: ``Respond in a way that is a, b:`` in trait order, or the
    neutral prompt when no trait passes the strict threshold."""
    descs = F.filter(F.array(*descriptions()), lambda x: x.isNotNull())
    return F.when(F.size(descs) == 0, F.lit(C.PROMPT_NEUTRAL)).otherwise(
        F.concat(F.lit(C.PROMPT_PREFIX), F.array_join(descs, ", "), F.lit(C.PROMPT_SUFFIX)))


def prompt_rows(rows: DataFrame) -> DataFrame:
    """B-5: prompt/completion projection; a missing utterance becomes ''."""
    return rows.withColumn("prompt", prompt()).withColumn(
        "completion", F.coalesce(F.col("utterance"), F.lit("")))


def converted_counts(prompts: DataFrame) -> DataFrame:
    """A-13: converted rows per shard plus the total (``rollup``; the total
    row has a null bucket)."""
    return prompts.rollup("bucket").agg(F.count(F.lit(1)).alias("n"))


def pole_vector(bucket: Column) -> list[Column]:
    """P-11: one-hot pole vector of a bucket name (prefix match)."""
    return [
        F.when(bucket.startswith(f"{t}_plus"), F.lit(1.0))
        .when(bucket.startswith(f"{t}_minus"), F.lit(-1.0)).otherwise(F.lit(0.0))
        for t in C.TRAITS
    ]


# ------------------------------------------------------------ requests ---

def fill_needs(spark: SparkSession, rows: DataFrame, target: int = C.TARGET_PER_BUCKET,
               buckets: list[str] | None = None) -> DataFrame:
    """D-5 / J-4 / N-3: need = max(0, target - existing) per requested bucket.
    Unknown bucket names are rejected; requested buckets with no shard
    count as 0 existing."""
    names = buckets or C.BUCKETS
    unknown = sorted(set(names) - set(C.BUCKETS))
    if unknown:
        raise ValueError(f"Unknown trait buckets: {unknown}. Available: {sorted(C.BUCKETS)}")
    dim = M.bucket_dim(spark).filter(F.col("bucket").isin(names))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("existing"))
    return dim.join(counts, "bucket", "left").select(
        "bucket", "description", "templates",
        F.coalesce(F.col("existing"), F.lit(0)).cast("long").alias("existing"),
        F.greatest(F.lit(target) - F.coalesce(F.col("existing"), F.lit(0)), F.lit(0)).cast("long").alias("need"),
    )


def numbered_pool(pool: DataFrame, text_col: str = "seed") -> DataFrame:
    """O-4: number the seeds of a pool of any size in a seeded hash order.  The
    hash is cut into ranges; a seed's number is the number of seeds in the
    ranges before plus its rank in its own, so no window spans the pool."""
    h = hash32(F.col(text_col), salt="pool")
    rows = written(pool.select(F.col(text_col).alias("seed"), h.alias("h"),
                               F.shiftright(h, 32 - POOL_RANGE_BITS).alias("range")), "seed-pool")
    sizes = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # 2 ** POOL_RANGE_BITS rows at most
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("h", "seed"))
    return rows.withColumn("rank", rank).join(F.broadcast(offsets), "range").select(
        "seed", (F.col("offset") + F.col("rank") - 1).cast("long").alias("seed_no"))


def paraphrase_requests(needs: DataFrame, pool: DataFrame,
                        factor: int = C.OVERSAMPLE_FACTOR, draw: int = 1) -> DataFrame:
    """N-1 with M-2 / M-3 / J-7: ``factor * need`` requests per bucket.

    Seeds are drawn without replacement when the pool is large enough (a
    contiguous run of the hash-shuffled pool starting at a per-bucket offset)
    and with replacement otherwise (hash-picked index).  Requests are
    generated with ``sequence``/``explode`` and matched to seeds by an
    equi-join on the seed number -- no cross product.  The template is one of
    the bucket's four, picked by hash.  Another ``draw`` picks other seeds and templates.
    """
    salt = "" if draw == 1 else str(draw)
    numbered = written(numbered_pool(pool), "seed-numbers")
    pool_size = numbered.count()
    if pool_size == 0:
        return numbered.select(F.lit(None).cast("string").alias("bucket"), F.lit(0).cast("long").alias("request_no"),
                               "seed", F.lit(None).cast("string").alias("system_prompt")).limit(0)
    req = (needs.filter(F.col("need") > 0)
           .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("need") * factor - 1)))
           .withColumn("pool_size", F.lit(pool_size).cast("long")))
    n_req = F.col("need") * factor
    offset = F.pmod(hash32(F.col("bucket"), salt=f"offset{salt}"), F.col("pool_size"))
    pick = F.pmod(hash32(F.col("bucket"), F.col("k").cast("string"), salt=f"pick{salt}"), F.col("pool_size"))
    req = req.withColumn(
        "seed_no", F.when(F.col("pool_size") >= n_req, F.pmod(offset + F.col("k"), F.col("pool_size")))
        .otherwise(pick))
    tmpl = F.get(F.col("templates"), F.pmod(hash32(F.col("bucket"), F.col("k").cast("string"), salt=f"tmpl{salt}"),
                                             F.lit(4)).cast("int"))
    return req.join(numbered, "seed_no").select(
        "bucket", F.col("k").alias("request_no"), "seed",
        F.concat(tmpl, F.lit(C.STYLE_JOIN), F.col("description")).alias("system_prompt"),
    )


def synthetic_rows(accepted: DataFrame) -> DataFrame:
    """N-2: accepted paraphrases as nested corpus rows: one-hot traits,
    synthetic source, deterministic id, tag = bucket, original seed."""
    b = F.col("bucket")
    vec = pole_vector(b)
    traits = F.struct(*[v.alias(t) for v, t in zip(vec, C.TRAITS)])
    return accepted.select(
        F.col("text").alias("utterance"),
        traits.alias("traits"),
        F.struct(
            F.lit(C.SYNTHETIC_SOURCE).alias("source"),
            F.sha2(F.concat_ws("|", b, F.col("text"), F.col("seed")), 256).alias("origin_id"),
            b.alias("original_tag"),
            F.col("seed").alias("original_seed"),
        ).alias("source_metadata"),
        b.alias("bucket"),
    )
