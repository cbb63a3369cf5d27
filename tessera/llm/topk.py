"""Exact top-k inner products with MaxScore.

Vectors become integers, ``floor(256 * x)``.  Query rows and all rows are dealt
into tiles of bounded size; a pair of tiles is one group and is searched alone,
so every query meets every row once.  In a tile each component is a term of the
query whose score is shifted to be at least zero; its bound is the term's range
over the tile.  Terms are ordered by bound, and the last ones whose bounds
together cannot lift a row over the query's current k-th score are
non-essential.  The columns (postings) of the essential terms are added up for
all rows; the others are probed one after another for rows that can still
compete.  The shards' lists are merged by a rank per query.

Vectors that are null or hold a null or non-finite component take no part; a
shorter vector counts as padded with zeros.  A null ``vec_id`` is never a query
and ranks after all ids of its score.  Repeated rows are rows of their own (a
query leaves out its own row only).  Components of any finite size are exact; a
score beyond 64 bits counts as the nearest 64-bit number.  An empty table gives an empty result; other columns are ignored.  Ties go to the smaller ``vec_id``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, ship_package

K = 5
EVERY = 50
SCALE = 256
ROW_TILE = 16_384
QUERY_TILE = 2_048
SEED_ROWS = 256
NO_ID = (1 << 63) - 1


def maxscore(rows: np.ndarray, ids: np.ndarray, own: np.ndarray, query: np.ndarray, query_own: int, k: int) -> list[tuple[int, int]]:
    """The k best ``(score, id)`` of ``rows`` (a column for each row, float with whole values) for one query."""
    low, high = rows.min(axis=1), rows.max(axis=1)
    least, most = np.minimum(query * low, query * high), np.maximum(query * low, query * high)
    base, bound = least.sum(), most - least
    terms = np.argsort(-bound, kind="stable")
    terms = terms[bound[terms] > 0]
    rest = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0.0]])  # bound of the terms from here on
    free = own != query_own
    first = np.flatnonzero(free[:SEED_ROWS])
    seed = query @ rows[:, first]
    floor = np.partition(seed, len(seed) - k)[len(seed) - k] if len(seed) >= k else -np.inf
    # with the non-essential terms alone a row stays below the k-th score
    essential = int(np.searchsorted(-rest, -(floor - base), side="right")) if floor > -np.inf else len(terms)
    essential = min(max(essential, 1), len(terms)) if len(terms) else 0
    some = np.flatnonzero(free)
    used = terms[:essential]
    score = base + query[used] @ rows[used] - least[used].sum() if essential else np.full(rows.shape[1], base)
    score = score[some]
    for j in range(essential, len(terms) + 1):
        if len(score) >= k:
            floor = max(floor, np.partition(score, len(score) - k)[len(score) - k])
            keep = score + rest[j] >= floor
            some, score = some[keep], score[keep]
        if j < len(terms):
            t = terms[j]
            score = score + query[t] * rows[t, some] - least[t]
    order = np.lexsort((ids[some], -score))[:k]
    return [(int(score[i]), int(ids[some[i]])) for i in order]


def _integers(x: np.ndarray) -> np.ndarray:
    """Whole-number floats as Python integers."""
    return np.array([int(v) for v in x.reshape(-1)], dtype=object).reshape(x.shape)


def wide_scores(rows: np.ndarray, ids: np.ndarray, own: np.ndarray, query: np.ndarray, query_own: int, k: int) -> list[tuple[int, int]]:
    """As ``maxscore``, in integers of any size, for tiles that floats do not add up exactly."""
    total = (rows * query[:, None]).sum(axis=0).tolist()
    found = [(max(-1 << 63, min(s, (1 << 63) - 1)), i) for s, i, o in zip(total, ids.tolist(), own.tolist()) if o != query_own]
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Whole-number components as columns of floats, padded to ``width``."""
    out = np.zeros((width, len(lists)))
    for i, values in enumerate(lists):
        own = np.asarray(values.as_py(), dtype=float)
        out[:len(own), i] = np.floor(SCALE * own)
    return out


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id is divisible by ``every``, against all other rows."""
    values = F.col("embedding").cast("array<double>")
    fine = values.isNotNull() & F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    v = saved(vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("v")).withColumn("own", F.monotonically_increasing_id()), "topk")
    is_query = F.col("vec_id") % every == 0
    n, n_queries, width = v.agg(F.count("*"), F.count_if(is_query), F.max(F.size("v"))).first()
    row_tiles, query_tiles = max(1, -(-n // ROW_TILE)), max(1, -(-n_queries // QUERY_TILE))
    width = max(width or 0, 1)
    slot = F.pmod(F.xxhash64("own"), F.lit(row_tiles)).cast("int")
    query_slot = F.pmod(F.xxhash64("own"), F.lit(query_tiles)).cast("int")
    rows = v.select(slot.alias("t"), F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1))).alias("q"), "vec_id", "own", "v")
    queries = v.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(row_tiles - 1))).alias("t"), query_slot.alias("q"), "vec_id", "own", "v")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            a, b = left.combine_chunks(), right.combine_chunks()
            rows = _matrix(a.column("v"), width)
            ids = np.array([NO_ID if x is None else x for x in a.column("vec_id").to_pylist()], dtype=np.int64)
            own = a.column("own").to_numpy()
            asked = _matrix(b.column("v"), width)
            large = max(np.abs(rows).max(), 1.0) * max(np.abs(asked).max(), 1.0) * width >= 2.0 ** 52
            whole = _integers(rows) if large else None
            for j, (query_id, query_own) in enumerate(zip(b.column("vec_id").to_pylist(), b.column("own").to_pylist())):
                best = wide_scores(whole, ids, own, _integers(asked[:, j]), query_own, k) if large else maxscore(rows, ids, own, asked[:, j], query_own, k)
                out += [(query_id, query_own, i, s) for s, i in best]
        columns = list(zip(*out)) if out else [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query_own", "vec_id", "score"])

    ship_package(vectors.sparkSession)
    found = rows.groupBy("t", "q").cogroup(queries.groupBy("t", "q")).applyInArrow(search, "query_id bigint, query_own bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id", "query_own").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
