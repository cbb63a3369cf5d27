"""Vector codes against plain k-means in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import vectorcodes as vc

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """``{(vec_id, place among equals): (code, error, label_error)}`` and the digest, from the definition."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    longest = max([len(r[1]) for r in kept], default=0)
    width = max(-(-longest // parts) * parts, parts)
    step = width // parts
    whole = [[int(x) * 4096 if abs(x) > 2 ** 52 else math.floor(4096 * x) for x in r[1]] + [0] * (width - len(r[1])) for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    books = [[whole[i][p * step:(p + 1) * step] for i in order[:entries]] for p in range(parts)]

    def assign(v, p):
        part = v[p * step:(p + 1) * step]
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds if kept else 0):
        for p in range(parts):
            at = [assign(v, p)[1] for v in whole]
            new = []
            for k, old in enumerate(books[p]):
                mine = [v[p * step:(p + 1) * step] for v, a in zip(whole, at) if a == k]
                new.append([sum(c) // len(mine) for c in zip(*mine)] if mine else old)
            books[p] = new
    out, by_label = [], {}
    for r, v in zip(kept, whole):
        found = [assign(v, p) for p in range(parts)]
        error = sum(d for d, _ in found)
        out.append((r[0], "".join(f"{k:02x}" for _, k in found), error, r[2]))
        by_label[r[2]] = by_label.get(r[2], 0) + error
    fit = lambda x: x if x < 1 << 63 else None
    rows = [(i, c, fit(e), fit(by_label[l])) for i, c, e, l in out]
    return rows, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def run(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions).withColumn("id", F.lit("clash")).withColumn("codes", F.lit(1)).withColumn("_of", F.lit(2))
    got = vc.vector_codes(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return got.collect()


def same(got, rows):
    want, digest = plain(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or -1)
    assert sorted([tuple(r)[:4] for r in got], key=key) == sorted(want, key=key)
    assert {r["codebooks_sha256"] for r in got} <= {digest}


@pytest.mark.parametrize("width", [16, 64, 13])
def test_matches_plain_k_means(spark, monkeypatch, width):
    rng = random.Random(width)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(width)], rng.choice([0, 1, None])) for i in range(300)]
    rows += [(300 + i, rows[5][1], 2) for i in range(80)] + [(None, rows[7][1], 1), (3, rows[9][1], None)]
    monkeypatch.setattr(vc, "TILE_ROWS", 70)
    same(run(spark, rows), rows)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.1] * 16, None), (3, [0.1, None] + [0.0] * 14, 1), (4, [nan] * 16, 1), (5, [inf] * 16, 1), (6, [], 3),
            (2, [0.1] * 16, None), (7, [-0.5], 3), (None, [0.25] * 16, None)]
    same(run(spark, rows), rows)
    assert run(spark, [(1, None, 1)]) == []


def test_large_components_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([1e20, -3e15, 0.3, 1e5, 7.0]) * rng.random() for _ in range(8)], i % 3) for i in range(60)]
    same(run(spark, rows), rows)
    middling = [(i, [rng.uniform(-2e5, 2e5) for _ in range(8)], i % 3) for i in range(60)]
    same(run(spark, middling), middling)


def test_shortlists_hold_every_nearest_entry():
    rng = np.random.default_rng(1)
    points = rng.integers(-900, 900, (1000, 8))
    book = np.concatenate([points[:15], points[:1]])  # the last entry ties with the first
    blocks, order = vc.make_blocks(points)
    short = vc.shortlists(blocks.min(axis=1), blocks.max(axis=1), book)
    at, best = vc.nearest(blocks, short, book)
    d = ((points[order][:, None] - book) ** 2).sum(axis=-1)
    assert (at.reshape(-1)[:1000] == d.argmin(axis=1)).all() and (best.reshape(-1)[:1000] == d.min(axis=1)).all()
    assert short.sum() < 0.9 * short.size


def test_hilbert_neighbours_touch():
    """Along the whole curve of a small grid each step changes one axis by one."""
    grid = np.stack(np.meshgrid(*[np.arange(4)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    fine = np.stack(np.meshgrid(*[np.arange(256)] * 2, indexing="ij"), axis=-1).reshape(-1, 2)
    for points, cell in ((fine, 1),):
        walk = points[np.argsort(vc.hilbert_keys(points), kind="stable")]
        assert (abs(np.diff(walk, axis=0)).sum(axis=1) == cell).all()
    assert len(set(vc.hilbert_keys(grid).tolist())) == len(grid)


def test_reconstruct(spark):
    rows = [(i, [i / 10] * 8, 0) for i in range(16)]
    coded, books = vc.compress(spark.createDataFrame(rows, SCHEMA))
    for r in coded.collect():
        assert vc.reconstruct(r["codes"], books) == [math.floor(4096 * r["id"] / 10)] * 8 and r["error"] == 0
