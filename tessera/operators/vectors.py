"""X-1..X-15, S-9: trait vectors from adapter names and weight-vector
analytics.

Per-vector statistics are row-local higher-order functions (no shuffle);
cross-vector checks are aggregates or equi-joins.  Doubles are rounded to
six decimals where the summation order is not fixed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.plan import fence
from .sample import hash32

ROUND = 6


# ------------------------------------------------------- name -> vector ---

def strict_vector(name: Column, traits=C.PLANNER_TRAITS) -> list[Column]:
    """X-1: +1 / -1 when the name starts or ends with <trait>_plus/_minus."""
    out = []
    for t in traits:
        plus, minus = f"{t}_plus", f"{t}_minus"
        out.append(F.when(name.startswith(plus) | name.endswith(plus), F.lit(1.0))
                   .when(name.startswith(minus) | name.endswith(minus), F.lit(-1.0)).otherwise(F.lit(0.0)))
    return out


def lenient_vector(name: Column, traits=C.LENIENT_TRAITS) -> tuple[list[Column], Column]:
    """X-2: substring matching with ``_plus``/``+`` and ``_minus``/``-``, a
    bare mention scores 0.5; a name matching nothing gets 0.3 in a slot
    chosen by a stable hash.  Returns (vector, fallback flag)."""
    low = F.lower(name)
    base = []
    for t in traits:
        base.append(
            F.when(low.contains(f"{t}_plus") | low.contains(f"{t}+"), F.lit(1.0))
            .when(low.contains(f"{t}_minus") | low.contains(f"{t}-"), F.lit(-1.0))
            .when(low.contains(t), F.lit(C.LENIENT_MENTION_SCORE)).otherwise(F.lit(0.0)))
    fallback = reduce(lambda a, b: a & b, [v == 0 for v in base])
    slot = F.pmod(hash32(name, salt="slot"), F.lit(len(traits)))
    vec = [F.when(fallback & (slot == i), F.lit(C.LENIENT_FALLBACK_SCORE)).otherwise(v) for i, v in enumerate(base)]
    return vec, fallback


def vector_table(names: DataFrame) -> DataFrame:
    """X-3: (name, file_path, v0..v9, zero) for every adapter name."""
    n = F.col("name")
    vec = strict_vector(n)
    return names.select(
        "name",
        F.concat(F.lit("lora_checkpoints/"), F.regexp_replace(n, r"\\", "/"), F.lit(".safetensors")).alias("file_path"),
        *[v.alias(f"v{i}") for i, v in enumerate(vec)],
    ).withColumn("zero_vector", reduce(lambda a, b: a & b, [F.col(f"v{i}") == 0 for i in range(len(vec))]))


def lenient_table(names: DataFrame) -> DataFrame:
    vec, fallback = lenient_vector(F.col("name"))
    return names.select("name", *[v.alias(f"v{i}") for i, v in enumerate(vec)], fallback.alias("fallback"))


def vector_audit(table: DataFrame) -> DataFrame:
    """X-15: per name, how many names share its exact vector, whether the
    vector is all zero and whether it is a hash fallback."""
    vcols = [c for c in table.columns if c.startswith("v") and c[1:].isdigit()]
    groups = table.groupBy(*vcols).agg(F.count(F.lit(1)).alias("n_sharing"), F.min("name").alias("first_name"))
    zero = reduce(lambda a, b: a & b, [F.col(c) == 0 for c in vcols])
    return table.join(groups, vcols).select(
        "name", "first_name", "n_sharing", (F.col("n_sharing") > 1).alias("shared"),
        zero.alias("zero_vector"), "fallback")


# ---------------------------------------------------- vector analytics ---

def _d(col: str = "embedding") -> Column:
    return F.transform(F.col(col), lambda x: x.cast("double"))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def vector_stats(df: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """X-7: mean, population variance/std, min, max (finite values), zeros
    (|x| < 1e-10) and non-finite count per vector, row-local."""
    v = _d(col)
    staged = df.select(F.col(id_col), v.alias("v"), F.size(col).alias("n"))
    mean = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x) / F.col("n")
    staged = staged.filter(F.col("n") > 0).withColumn("mean", mean)
    var = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + (x - F.col("mean")) * (x - F.col("mean"))) / F.col("n")
    fin = F.filter("v", finite)
    return staged.select(
        F.col(id_col), F.col("n").cast("long").alias("n"),
        F.round("mean", ROUND).alias("mean"),
        F.round(var, ROUND).alias("variance"),
        F.round(F.sqrt(var), ROUND).alias("std"),
        F.array_min(fin).alias("min"), F.array_max(fin).alias("max"),
        F.size(F.filter("v", lambda x: F.abs(x) < C.ZERO_EPSILON)).cast("long").alias("zeros"),
        F.size(F.filter("v", lambda x: ~finite(x))).cast("long").alias("non_finite"),
    )


def validity(stats: DataFrame, expected: int | None = None) -> DataFrame:
    """X-8 / X-9: all finite, all vary, dimensional consistency, processed
    count (equal to ``expected`` when given)."""
    return stats.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.count_distinct("n").alias("n_dims"),
        F.min_by("n", F.col(stats.columns[0])).alias("first_dim"),
        F.bool_and(F.col("non_finite") == 0).alias("all_finite"),
        F.bool_and(F.col("variance") > 0).alias("all_vary"),
    ).withColumn("consistent_dims", F.col("n_dims") == 1).withColumn(
        "all_processed", F.lit(True) if expected is None else F.col("n_vectors") == F.lit(expected))


def duplicate_signatures(df: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """X-10: vectors grouped by their first ten values."""
    sig = F.slice(F.col(col), 1, C.SIGNATURE_VALUES)
    return df.groupBy(sig.alias("sig")).agg(
        F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n_vectors")).select(
        "first_id", "n_vectors", (F.col("n_vectors") - 1).alias("duplicates"))


def cosine(a: Column, b: Column) -> Column:
    """X-6: cosine similarity accumulated in double; null when a norm is 0
    or the lengths differ (guarded, never a division error)."""
    da = F.transform(a, lambda x: x.cast("double"))
    db = F.transform(b, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(da, db, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    na = F.aggregate(da, F.lit(0.0), lambda acc, x: acc + x * x)
    nb = F.aggregate(db, F.lit(0.0), lambda acc, x: acc + x * x)
    den = F.sqrt(na) * F.sqrt(nb)
    return F.when((F.size(a) == F.size(b)) & (den > 0), dot / den)


def triplets(df: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """X-11: anchor i, near i+1, far i+2 (equi-joins on shifted ids); the
    similarity order holds when near scores above far."""
    a = df.select(F.col(id_col).alias("anchor"), F.col(col).alias("a"))
    b = df.select((F.col(id_col) - 1).alias("anchor"), F.col(col).alias("b"))
    c = df.select((F.col(id_col) - 2).alias("anchor"), F.col(col).alias("c"))
    j = a.join(b, "anchor").join(c, "anchor")
    near = F.round(cosine(F.col("a"), F.col("b")), ROUND)
    far = F.round(cosine(F.col("a"), F.col("c")), ROUND)
    return j.select("anchor", near.alias("cos_near"), far.alias("cos_far")).withColumn(
        "order_holds", F.coalesce(F.col("cos_near") > F.col("cos_far"), F.lit(False)))


def global_distribution(df: DataFrame, col: str = "embedding") -> DataFrame:
    """X-12: mean, population std, min, max over every value of every vector.
    A vector becomes one row of count, mean and squared deviations within the
    scan; these are combined by partial aggregates, so nothing is a row per value."""
    v = F.col("v")
    n = F.size(v).cast("double")
    rows = fence(df.select(_d(col).alias("v")).filter(F.size(v) > 0).select("v", (F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n).alias("m")))
    m = F.col("m")
    rows = rows.select(n.alias("n"), "m", F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)).alias("s"), F.array_min(v).alias("low"), F.array_max(v).alias("high"))
    total = rows.agg(F.sum("n").alias("n"), F.sum(F.col("n") * m).alias("t"), F.sum(F.col("s") + F.col("n") * m * m).alias("q"), F.min("low").alias("min"), F.max("high").alias("max"))
    mean = F.col("t") / F.col("n")
    return total.select(
        F.coalesce(F.col("n"), F.lit(0.0)).cast("long").alias("n_values"), F.round(mean, ROUND).alias("mean"),
        F.round(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))), ROUND).alias("std"), "min", "max")


def fit(col: Column, dim: int = C.VECTOR_DIM) -> Column:
    """X-5: truncate or zero-pad a vector to ``dim`` values."""
    n = F.size(col)
    return F.when(n >= dim, F.slice(col, 1, dim)).otherwise(
        F.concat(col, F.array_repeat(F.lit(0.0).cast("float"), F.lit(dim) - n)))


def fitted(df: DataFrame, id_col: str = "vec_id", col: str = "embedding", dim: int = C.VECTOR_DIM) -> DataFrame:
    f = fit(F.col(col), dim)
    staged = df.select(F.col(id_col), F.size(col).alias("n"), f.alias("f"))
    l2 = F.sqrt(F.aggregate(F.transform("f", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x * x))
    return staged.select(
        F.col(id_col), F.size("f").cast("long").alias("fitted_dim"),
        F.greatest(F.lit(dim) - F.col("n"), F.lit(0)).cast("long").alias("padded"),
        F.round(l2, ROUND).alias("l2"))


# -------------------------------------------------------------- adapters ---

TENSORS_PER_ADAPTER = 8


def adapter_tensors(embeddings: DataFrame) -> DataFrame:
    """S-9 (long form): (adapter, tensor_key, pos, value).  Test-table
    stand-in: every 8 consecutive vectors form one adapter whose tensors are
    ``layers.<k>.lora_A`` / ``lora_B`` (an architecture-sized key set)."""
    vid = F.col("vec_id")
    k = F.pmod(vid, F.lit(TENSORS_PER_ADAPTER))
    key = F.concat(F.lit("layers."), F.floor(k / 2).cast("string"), F.lit(".lora_"),
                   F.when(F.pmod(k, F.lit(2)) == 0, F.lit("A")).otherwise(F.lit("B")))
    return embeddings.select(
        F.concat(F.lit("adapter_"), F.floor(vid / TENSORS_PER_ADAPTER).cast("string")).alias("adapter"),
        key.alias("tensor_key"),
        F.posexplode("embedding").alias("pos", "value"),
    ).select("adapter", "tensor_key", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double"))


def tensor_layout(tensors: DataFrame, reference: str) -> DataFrame:
    """X-4: key order and offsets from the reference adapter.  The layout
    table has one row per tensor key (bounded by the architecture)."""
    from pyspark.sql import Window
    ref = tensors.filter(F.col("adapter") == reference).groupBy("tensor_key").agg(
        F.count(F.lit(1)).alias("numel"))
    w = Window.orderBy("tensor_key").rowsBetween(Window.unboundedPreceding, -1)
    return ref.withColumn("offset", F.coalesce(F.sum("numel").over(w), F.lit(0)).cast("long"))


def flatten_adapters(tensors: DataFrame, reference: str) -> DataFrame:
    """X-4: (adapter, flat_pos, value) in the reference key order, plus the
    per-adapter length check against the reference vector length."""
    layout = tensor_layout(tensors, reference)
    flat = tensors.join(F.broadcast(layout), "tensor_key").select(
        "adapter", "tensor_key", (F.col("offset") + F.col("pos")).alias("flat_pos"), "value")
    # the layout has one row per tensor key (architecture-bounded): its
    # totals are scalars, attached as literals rather than by a join
    totals = layout.agg(F.sum("numel").alias("expected"), F.count(F.lit(1)).alias("expected_tensors")).first()
    summary = (tensors.groupBy("adapter").agg(F.count_distinct("tensor_key").alias("n_tensors"),
                                               F.count(F.lit(1)).alias("n_values"))
               .withColumn("expected", F.lit(totals["expected"]).cast("long"))
               .withColumn("expected_tensors", F.lit(totals["expected_tensors"]).cast("long")))
    summary = summary.withColumn("length_ok", (F.col("n_values") == F.col("expected"))
                                 & (F.col("n_tensors") == F.col("expected_tensors")))
    return flat, summary


#: Values in a block of a tensor at most.
BLOCK = 64


def adapter_blocks(embeddings: DataFrame) -> DataFrame:
    """``adapter, tensor_key, block, values``: the tensors of ``adapter_tensors`` as blocks of at most ``BLOCK`` values."""
    vid = F.col("vec_id")
    k = F.pmod(vid, F.lit(TENSORS_PER_ADAPTER))
    key = F.concat(F.lit("layers."), F.floor(k / 2).cast("string"), F.lit(".lora_"), F.when(F.pmod(k, F.lit(2)) == 0, F.lit("A")).otherwise(F.lit("B")))
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("embedding") / BLOCK).cast("int") - 1), lambda i: F.slice("embedding", i * BLOCK + 1, BLOCK).cast("array<double>"))
    return embeddings.filter(F.size("embedding") > 0).select(
        F.concat(F.lit("adapter_"), F.floor(vid / TENSORS_PER_ADAPTER).cast("string")).alias("adapter"), key.alias("tensor_key"), F.posexplode(parts).alias("block", "values"))


def to_blocks(tensors: DataFrame) -> DataFrame:
    """``adapter, tensor_key, block, values`` from a table of whole tensors (``adapter, tensor_key, values``)."""
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("values") / BLOCK).cast("int") - 1), lambda i: F.slice("values", i * BLOCK + 1, BLOCK))
    return tensors.filter(F.size("values") > 0).select("adapter", "tensor_key", F.posexplode(parts).alias("block", "values"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def weight_norms(blocks: DataFrame, reference: str) -> DataFrame:
    """X-13: sum of squares over lora_A and lora_B tensors per adapter, and the
    mean absolute difference to the reference adapter (a join of blocks; a value
    without a counterpart does not count)."""
    squares = _sum(F.transform("values", lambda x: x * x))
    rows = blocks.select("adapter", "tensor_key", squares.alias("q"))
    sq = rows.groupBy("adapter").agg(
        F.round(F.sum(F.when(F.col("tensor_key").endswith("lora_A"), F.col("q"))), ROUND).alias("sumsq_a"),
        F.round(F.sum(F.when(F.col("tensor_key").endswith("lora_B"), F.col("q"))), ROUND).alias("sumsq_b"))
    ref = blocks.filter(F.col("adapter") == reference).select("tensor_key", "block", F.col("values").alias("other"))
    apart = F.filter(F.zip_with("values", "other", lambda x, y: F.abs(x - y)), lambda x: x.isNotNull())
    diff = fence(blocks.join(ref, ["tensor_key", "block"]).select("adapter", apart.alias("apart"))).select("adapter", _sum(F.col("apart")).alias("t"), F.size("apart").alias("n")) \
        .groupBy("adapter").agg(F.round(F.sum("t") / F.sum("n"), ROUND).alias("mean_abs_diff_to_ref"))
    return sq.join(diff, "adapter", "left")


def blend_blocks(blocks: DataFrame, weights: DataFrame) -> DataFrame:
    """X-14: weighted combination of adapters, linear in weight space, as
    ``tensor_key, block, size, values, n_adapters``.  Arrays are added place by
    place in one partial aggregate: a task sends one row for each block, not one
    for each weight and adapter.  Blocks of different sizes (adapters whose
    tensors differ in length) are added up apart."""
    size = F.size("values").alias("size")
    weighted = blocks.join(weights, "adapter").select("tensor_key", "block", size, *[(F.col("weight") * F.get("values", F.lit(i))).alias(f"v{i}") for i in range(BLOCK)])
    sums = weighted.groupBy("tensor_key", "block", "size").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(BLOCK)], F.count(F.lit(1)).alias("n_adapters"))
    return sums.select("tensor_key", "block", "size", F.slice(F.array(*[f"v{i}" for i in range(BLOCK)]), F.lit(1), F.col("size")).alias("values"), "n_adapters")


def blend(blocks: DataFrame, weights: DataFrame) -> DataFrame:
    """X-14 in long form: ``tensor_key, pos, value, n_adapters``."""
    rows = blend_blocks(blocks, weights).select("tensor_key", "block", "n_adapters", F.posexplode("values").alias("i", "x"))
    return rows.groupBy("tensor_key", (F.col("block").cast("long") * BLOCK + F.col("i")).alias("pos")).agg(
        F.round(F.sum("x"), ROUND).alias("value"), F.sum("n_adapters").alias("n_adapters"))
