"""SimHash near-duplicates by tiled exact comparison.

Fingerprint: majority vote per bit over the XXH64 values (seed 42) of a text's
word shingles, repeats included.  Distinct fingerprints are laid out in tiles by
the population counts of their four 16-bit quarters.  The sum of the four
differences never exceeds the bit distance, so two tiles whose counts differ by
more than the radius in sum hold no link and are skipped; every other pair of
tiles is compared in full with numpy exclusive-or and bit counts.  A large tile
is cut into blocks, so that a task holds two blocks at a time however many
fingerprints share the counts.  Of a pair of blocks only a spanning forest of its
links leaves the task; that keeps components whole without emitting all pairs.

A null or wordless text has fingerprint zero and is linked like any other.  A
component is named by its smallest non-null ``doc_id`` (null if it has none).
Repeated rows give repeated rows.  An empty table gives an empty result.  Extra
input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, saved, slices
from .graph import connected_components

SHINGLE = 3
RADIUS = 3
SEED = 42
BLOCK = 4096
QUARTERS = 4
#: Quarter counts (0 to 16) are digits of a tile's number; the base leaves room for a step out of range on either side.
BASE = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of a whole text (unsigned)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        values = np.array([digest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-shingle])).tolist()
        values = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())), np.uint64, len(starts))
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), 8192):  # bounded memory for very long texts
        part = values[i:i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(values), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: ``doc_id``) and ``_fp`` (the fingerprint's bits as a signed long)."""
    keep = ["doc_id"] if keep is None else keep
    read = [*keep, *([] if "text" in keep else ["text"])]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                bits = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(bits, pa.int64())], names=[*keep, "_fp"])

    d = docs.select(*read)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields if f.name in keep)
    return map_arrow(d, run, f"{schema}, _fp bigint")


def _tile(fp: Column) -> Column:
    tile = F.lit(0)
    for k in range(QUARTERS):
        quarter = F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(65535))
        tile = tile * BASE + F.bit_count(quarter)
    return tile


def _steps(radius: int) -> list[int]:
    """Differences of tile numbers to compare a tile with: itself, and one of each two opposite steps within the radius."""
    out = []

    def go(k: int, left: int, number: int) -> None:
        if k == QUARTERS:
            if number >= 0:
                out.append(number)
            return
        for d in range(-left, left + 1):
            go(k + 1, left - abs(d), number * BASE + d)

    go(0, radius, 0)
    return sorted(out)


def block_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links (distance within the radius) between two
    blocks of distinct fingerprints, as index pairs of their concatenation."""
    near = np.zeros((len(a), len(b)), dtype=bool)
    for i in range(0, len(a), 256):
        near[i:i + 256] = np.bitwise_count(a[i:i + 256, None] ^ b[None, :]) <= radius
    if same:
        np.fill_diagonal(near, False)
    open_a = near.any(axis=1)
    found = []
    seen_b = np.zeros(len(b), dtype=bool)
    shift = 0 if same else len(a)
    while open_a.any():
        root = int(np.argmax(open_a))
        front = np.array([root])
        open_a[root] = False
        if same:
            seen_b[root] = True
        while len(front):
            ys = np.flatnonzero(near[front].any(axis=0) & ~seen_b)
            seen_b[ys] = True
            found += [(root, int(y) + shift) for y in ys]
            if same:
                open_a[ys] = False
                front = ys
            else:
                front = np.flatnonzero(near[:, ys].any(axis=1) & open_a) if len(ys) else ys
                open_a[front] = False
                found += [(root, int(x)) for x in front]
    return found


def fingerprint_components(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``_fp, _root`` for every fingerprint that has a link; ``fingerprints`` has distinct values in ``_fp``."""
    tiled = saved(fingerprints.select("_fp", _tile(F.col("_fp")).alias("tile")), "simhash-tiles")
    # at most 17 ** 4 tiles exist, whatever the number of documents
    tiles = saved(tiled.groupBy("tile").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks")), "simhash-counts")
    blocks = tiled.join(F.broadcast(tiles), "tile") \
        .groupBy("tile", F.pmod(F.xxhash64("_fp"), F.col("n_blocks")).cast("int").alias("block")) \
        .agg(F.sort_array(F.collect_list("_fp")).alias("fps"))
    blocks = saved(blocks, "simhash-blocks")
    steps = F.array(*[F.lit(s) for s in _steps(radius)])
    left = blocks.select("tile", "block", "fps", F.explode(steps).alias("step")).withColumn("tile2", F.col("tile") + F.col("step"))
    there = tiles.select(F.col("tile").alias("tile2"), F.col("n_blocks").alias("n2"))
    left = left.join(F.broadcast(there), "tile2") \
        .withColumn("block2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1))) \
        .where((F.col("step") > 0) | (F.col("block2") >= F.col("block")))
    right = blocks.select(F.col("tile").alias("tile2"), F.col("block").alias("block2"), F.col("fps").alias("fps2"))
    pairs = left.join(right, ["tile2", "block2"]).select(
        "fps", "fps2", ((F.col("step") == 0) & (F.col("block") == F.col("block2"))).alias("same"))

    def run(batches):
        for batch in batches:
            one, two, same = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            u, v = [], []
            for i, own in enumerate(same):
                a = one[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                b = two[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                both = a if own else np.concatenate([a, b])
                for x, y in block_links(a, b, radius, own):
                    u.append(both[x])
                    v.append(both[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64), pa.int64()) for x in (u, v)], names=["u", "v"])

    links = map_arrow(pairs, run, "u bigint, v bigint")
    return connected_components(links, "u", "v").select(F.col("node").alias("_fp"), F.col("component").alias("_root"))


def _with_roots(marked: DataFrame, radius: int) -> DataFrame:
    """``marked`` (with ``_fp``) and ``_root``, one value for each component."""
    roots = saved(fingerprint_components(marked.select("_fp").distinct(), radius), "simhash-roots")
    return marked.join(roots, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per document: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``."""
    marked = _with_roots(saved(with_fingerprints(docs, shingle), "simhash"), radius)
    least = marked.groupBy("_root").agg(F.min("doc_id").alias("component_id"))
    return marked.join(least, "_root").select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id, a
    null id after all others, equal ids by the hash of the text."""
    order = [F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("_sh_id"), F.xxhash64("text").alias("_sh_text")]
    d = docs.select(F.struct(*docs.columns).alias("_sh_row"), "text", *order)
    marked = saved(with_fingerprints(d.select("_sh_id", "_sh_text", "text"), shingle, ["_sh_id", "_sh_text"]), "simhash")
    first = _with_roots(marked, radius).groupBy("_root").agg(F.min(F.struct("_sh_id", "_sh_text")).alias("m")).select("m._sh_id", "m._sh_text")
    kept = d.join(first.distinct(), ["_sh_id", "_sh_text"], "left_semi")
    place = F.row_number().over(W.partitionBy("_sh_id", "_sh_text").orderBy("_sh_id"))
    return kept.withColumn("_sh_place", place).where("_sh_place = 1").select("_sh_row.*")
