"""M-1..M-3, O-3, O-4: deterministic sampling and ordering.

Sampling is a pure row predicate on a hash of the row's identity, so it is
pushed down like any filter, needs no shuffle, is idempotent and gives the
same rows for any partitioning.  The 32-bit hash (first 8 hex digits of md5)
is shared with the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C

DEFAULT_SALT = "m1"
RATE_SCALE = 10000


def hash32(*cols: Column, salt: str = DEFAULT_SALT) -> Column:
    """First 8 hex digits of md5(salt|c1|c2...) as a non-negative bigint."""
    key = F.concat(F.lit(salt), *[x for c in cols for x in (F.lit("|"), c)])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def stratum_rate() -> Column:
    """Sampling rate (per 10 000) for each (source, tag) stratum; rows of
    unknown sources, and null tags in the tag-split sources, get 0."""
    src, tag = F.col("source"), F.col("original_tag")
    expr = None
    for source, t, rate in C.SAMPLING_STRATA:
        r = int(round(rate * RATE_SCALE))
        branches = (
            [(src == source, r)] if t is None
            else [((src == source) & (tag == t), r), ((src == source) & (tag != t), RATE_SCALE), (src == source, 0)]
        )
        for cond, val in branches:
            expr = F.when(cond, F.lit(val)) if expr is None else expr.when(cond, F.lit(val))
    return expr.when(src.isin(C.SAMPLING_SOURCES), F.lit(RATE_SCALE)).otherwise(F.lit(0))


def keep(salt: str = DEFAULT_SALT) -> Column:
    """M-1 predicate: hash(source, origin_id) mod 10 000 < the stratum rate."""
    h = hash32(F.col("source"), F.col("origin_id"), salt=salt)
    return F.coalesce(F.pmod(h, F.lit(RATE_SCALE)) < stratum_rate(), F.lit(False))


def stratified_sample(corpus: DataFrame, salt: str = DEFAULT_SALT) -> DataFrame:
    """M-1: keep a row iff hash(source, origin_id) mod 10 000 < its rate."""
    return corpus.filter(keep(salt))


def random_sample(corpus: DataFrame, seed: int) -> DataFrame:
    """M-1 in its random form: each row of a stratum is kept with the stratum's
    rate, independently of the others (Bernoulli).  A seed gives the same rows
    again only for the same partitions of the same rows; the hash form does so always."""
    return corpus.filter(F.coalesce(F.rand(seed) * RATE_SCALE < stratum_rate(), F.lit(False)))
