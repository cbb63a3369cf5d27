"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Every document of a source gets the mean repetition rate ``target share x total
size x scale / size of the source``.  Its number of copies is a Poisson variate
with that mean, found by inverting the distribution at numbers drawn from a hash
of seed and document; the document is exploded by that number and the copies are
dealt out and sorted by a hash of seed, document and copy.  The result depends on
the rows and the seed alone, so a recomputed task gives the same rows.

Sizes are numbers of characters.  A null source is a source of its own; a null
text has size 0.  A document without an id is drawn by the hash of its text.
Repeated rows draw the same count.  A source whose size is 0 keeps its rows at
rate 1.  Input columns that are named ``mix_copy`` or ``mix_key`` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, saved, whole

SEED = 17
TEMPERATURE = 0.5
#: A large mean is split into equal parts of at most this, drawn independently and added up.
PART = 8.0
#: Terms of the distribution function of a part; beyond them it is 1 to the last bit.
TERMS = 64
UNIT = float(1 << 52)


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, scale: float = 1.0) -> DataFrame:
    """Per source: ``_mix_source, _mix_size, _mix_rate``.  ``weights`` are target
    shares (a source not named gets 0); without them a share is in proportion to
    ``size ** temperature``."""
    sizes = docs.groupBy(F.col("source").alias("_mix_source")).agg(F.sum(F.length(whole())).cast("double").alias("_mix_size"))
    if weights is None:
        share = F.pow("_mix_size", F.lit(temperature))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("_mix_source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(share)
    sizes = saved(sizes.withColumn("_mix_share", share), "mix-sizes")
    total = sizes.agg(F.sum("_mix_size"), F.sum("_mix_share")).first()
    size, shares = total[0] or 0.0, total[1] or 0.0
    rate = F.when(F.col("_mix_size") == 0, F.lit(1.0)).otherwise(F.col("_mix_share") / F.lit(shares or 1.0) * F.lit(size * scale) / F.col("_mix_size"))
    return sizes.select("_mix_source", "_mix_size", rate.alias("_mix_rate"))


def _distribution(mean: Column) -> Column:
    """Distribution function of a Poisson variate at 0, 1, ... as an array."""
    start = F.struct(F.exp(-mean).alias("p"), F.lit(0.0).alias("c"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)), start,
        lambda a, k: F.struct((a["p"] * mean / k).alias("p"), (a["c"] + a["p"]).alias("c"), F.concat(a["out"], F.array(a["c"] + a["p"])).alias("out")),
        lambda a: a["out"])


def _uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the key's md5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(UNIT)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, scale: float = 1.0, seed: int = SEED) -> DataFrame:
    """``docs`` replicated and globally shuffled, with ``mix_copy`` (from 1) and ``mix_key`` (the order of the mixture)."""
    rates = source_rates(docs, weights, temperature, scale)
    parts = F.greatest(F.ceil(F.col("_mix_rate") / PART), F.lit(1))
    rates = saved(rates.withColumn("_mix_parts", parts.cast("int")).withColumn("_mix_cdf", _distribution(F.col("_mix_rate") / F.col("_mix_parts"))), "mix-rates")
    columns = [c for c in docs.columns if c not in ("mix_copy", "mix_key")]
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.md5(whole())))
    d = docs.select(F.struct(*columns).alias("_mix_row"), name.alias("_mix_name"))  # the row in one column: no name can clash
    d = d.join(broadcast_if_small(rates, rates.count(), 20_000), F.col("_mix_row.source").eqNullSafe(F.col("_mix_source")))
    drawn = F.transform(F.sequence(F.lit(1), F.col("_mix_parts")), lambda j: _uniform(F.concat_ws("|", F.col("_mix_name"), j.cast("string"))))
    count = F.aggregate(drawn, F.lit(0), lambda n, u: n + F.size(F.filter("_mix_cdf", lambda c: u >= c)))
    d = d.withColumn("_mix_count", count).where(F.col("_mix_count") > 0)
    d = d.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_count").cast("long"))))
    d = d.withColumn("mix_key", F.md5(F.concat_ws("|", F.col("_mix_name"), F.lit("copy"), F.col("mix_copy").cast("string"))))
    return d.select("_mix_row.*", "mix_copy", "mix_key").repartition("mix_key").sortWithinPartitions("mix_key")


def poisson_count(u: float, mean: float) -> int:
    """Scalar form of one draw, for tests: the number of terms of the distribution function at or below ``u``."""
    p, c, n = math.exp(-mean), 0.0, 0
    for k in range(1, TERMS + 1):
        c += p
        n += u >= c
        p = p * mean / k
    return n
