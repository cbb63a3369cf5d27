"""Exact Jaccard join of word-shingle sets by signature trees.

Documents with the same set of shingles are one class; only classes are
compared.  Three steps, none of which gathers an unbounded group:

1. Filter.  Of a set of ``n`` hashes the smallest ``n - ceil(0.8 n) + n // 4``
   are its prefix; two sets that link share at least ``n // 4`` (of the size
   just allowed) hashes of their prefixes.  Prefixes are dealt to hash ranges in
   packed blocks and come back with the number of classes that hold each hash.  A
   class with too few shared ones links with nothing.  Hashes that a thousandth of the
   documents hold are found by counting first and broadcast (at most 2,000 times the
   mean prefix in number), so they are never gathered.  The others that are left meet on the rarest of
   their shared hashes; classes connected so form a block, and every link lies within one block.
2. Trees.  A block is cut into tiles by size and smallest hash: at most ``TILE``
   classes and ``TILE_HASHES`` hashes, or one class.  A tile is a hierarchy of nodes with the OR of their
   sets' bitmaps, the range of sizes and the greatest number of hashes that a bitmap hides by collisions.
   A dual traversal goes down pairs of nodes level by level and drops those
   whose sizes cannot match, whose greatest possible overlap is below the least
   required, or which are already in one component.  What is left is compared
   exactly, and a spanning forest of the links leaves the task.
3. Tiles of one block whose sizes can match are paired: first with the first tile of their
   size class, then, where the components found so far do not already join them, with each other.
   Blocks of one tile, nearly all of them, need no pairs.

Shingles are 64-bit hashes (as exact as those are); the components are those of
the full graph of links.  In the worst case (a block of very many classes that share their
rarest hashes and yet do not link) the tile pairs of that block are all compared.

Defined cases.  A null or wordless text has an empty set and links with nothing,
not even its like.  A text of fewer words than a shingle is one shingle.  A
component is named by its smallest non-null ``doc_id`` (null if it has none).
Repeated rows give repeated rows.  An empty table gives an empty result.  Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, map_arrow, saved, ship_package, slices, with_rank
from .graph import connected_components

SHINGLE = 5
#: A link: ``100 * intersection >= PERCENT * union``.
PERCENT = 80
SEED = 11
#: Share of the documents from which a hash is hot, and the least number.
HOT_SHARE = 0.001
HOT_LEAST = 1000
#: Prefix hashes that a worker holds before it sends, and that a hash range holds about.
HELD = 4_000_000
RANGE = 1_000_000
#: Classes and hashes of a tile at most; sets in a leaf, children of a node.
TILE = 1024
TILE_HASHES = 1 << 21
LEAF = 8
FANOUT = 8
KEYS_BROADCAST = 1_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def needed(n: int, percent: int = PERCENT) -> int:
    """Shared shingles that a set of ``n`` needs for a link with any other."""
    return -(-percent * n // 100)


def spare(n: int) -> int:
    return max(1, n // 4)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - needed(n, percent) + spare(n) if n else 0


def shared_size(n: int, percent: int = PERCENT) -> int:
    """Hashes of its prefix that a set of ``n`` shares with the prefix of any set that it links with."""
    return spare(needed(n, percent))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[bytes | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text."""
    words, counts = [], []
    for t in texts:
        own = (t or b"").lower().split()
        words += own
        counts.append(len(own))
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    of_word = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    w = of_word[coded.indices.to_numpy(zero_copy_only=False)] if words else np.zeros(0, np.uint64)
    last = max(len(w) - shingle + 1, 0)
    rolled = np.full(last, shingle, dtype=np.uint64)
    for k in range(shingle):
        rolled = _mix(rolled * _MULTIPLIER + w[k:k + last])
    out, a = [], 0
    for n in counts:
        if n >= shingle:
            out.append(np.unique(rolled[a:a + n - shingle + 1]))
        elif n:
            h = np.full(1, n, dtype=np.uint64)
            for x in w[a:a + n]:
                h = _mix(h * _MULTIPLIER + x)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        a += n
    return out


def _keyed(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``doc_id, text_key`` (MD5 of the text) ``, digest`` (of the set) ``, key`` (its first 64 bits) ``, n, prefix``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column(2).to_pylist(), shingle)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array([s[:prefix_size(len(s), percent)].tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "text_key", "digest", "key", "n", "prefix"])

    text = F.col("text").cast("string")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("text_key"), text.cast("binary").alias("text")), run,
                     f"doc_id {kind}, text_key binary, digest binary, key bigint, n bigint, prefix binary")


def _hashes(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 64-bit values of a binary column, and how many each row has."""
    parts = [np.frombuffer(x.as_buffer() if x.is_valid else b"", np.uint64) for x in raw]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array([len(p) for p in parts], dtype=np.int64)


def _hot(keyed: DataFrame, rows: int, share: float, least: int) -> np.ndarray:
    """Hashes that at least ``share`` of the documents (and ``least`` of them) have in their prefix, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, docs = [], 0, 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts >= max(2, share / 4 * docs)
            return pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(counts[some], pa.int64())], names=["h", "c"])

        for batch in batches:
            values, _ = _hashes(batch.column(0))
            held.append(values)
            size += len(values)
            docs += batch.num_rows
            if size > HELD:
                yield flush()
                held, size, docs = [], 0, 0
        if held:
            yield flush()

    found = map_arrow(keyed.select("prefix"), run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    hot = [r["h"] for r in found.where(F.col("c") >= max(least, share / 2 * rows)).collect()]
    return np.unique(np.array(hot, dtype=np.int64).view(np.uint64))


def _dealt(keyed: DataFrame, bits: int, hot: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Prefix hashes in blocks by hash range, and each class's hot hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        keys: list[int] = []
        sizes: list[int] = []
        seen: set[int] = set()
        total = 0

        def flush():
            values = np.concatenate(held)
            at = np.repeat(np.arange(len(held), dtype=np.uint32), [len(p) for p in held])
            order = np.argsort(values, kind="stable")
            values, at = values[order], at[order]
            cuts = np.searchsorted(values >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            of_key, of_size = np.array(keys, np.int64), np.array(sizes, np.int64)
            columns: list[list] = [[], [], [], [], []]
            for r in range(1 << bits):
                a, b = cuts[r], cuts[r + 1]
                if b > a:
                    docs, own = np.unique(at[a:b], return_inverse=True)
                    for column, x in zip(columns, (r, values[a:b].tobytes(), own.astype("<u4").tobytes(), of_key[docs].tobytes(), of_size[docs].tobytes())):
                        column.append(x)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                                              names=["range", "hashes", "own", "keys", "sizes"])

        for batch in batches:
            for key, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if key in seen or not n:
                    continue
                seen.add(key)
                values = np.frombuffer(raw.as_buffer(), np.uint64)
                if len(hot):
                    values = values[~np.isin(values, hot)]
                held.append(values)
                keys.append(key)
                sizes.append(n)
                total += len(values)
                if total > HELD or len(seen) > 1_000_000:
                    yield flush()
                    held, keys, sizes, total = [], [], [], 0
                    seen.clear()
        if held:
            yield flush()

    def own_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], []]
            for key, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                values = np.frombuffer(raw.as_buffer(), np.uint64)
                mine = values[np.isin(values, hot)]
                if len(mine):
                    for column, x in zip(out, (key, n, mine.tobytes())):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["key", "n", "hashes"])

    source = keyed.select("key", "n", "prefix").where("n > 0")
    blocks = map_arrow(source, run, "range int, hashes binary, own binary, keys binary, sizes binary")
    return blocks, map_arrow(source, own_hot, "key bigint, n bigint, hashes binary")


def _count_range(table: pa.Table) -> pa.Table:
    """One hash range: each class's hashes that other classes hold too, with the numbers of classes."""
    hashes, keys, sizes = [], [], []
    for h, own, k, n in zip(*(table.column(c) for c in ("hashes", "own", "keys", "sizes"))):
        at = np.frombuffer(own.as_buffer(), "<u4")
        hashes.append(np.frombuffer(h.as_buffer(), np.uint64))
        keys.append(np.frombuffer(k.as_buffer(), np.int64)[at])
        sizes.append(np.frombuffer(n.as_buffer(), np.int64)[at])
    h, k, n = np.concatenate(hashes), np.concatenate(keys), np.concatenate(sizes)
    order = np.lexsort((k, h))
    h, k, n = h[order], k[order], n[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])  # a class that several tasks saw
    h, k, n = h[first], k[first], n[first]
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    held = counts[inverse]
    some = held >= 2
    h, k, n, held = h[some], k[some], n[some], held[some]
    order = np.argsort(k, kind="stable")
    h, k, n, held = h[order], k[order], n[order], held[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    ends = [*starts[1:].tolist(), len(k)]
    return pa.table({
        "key": pa.array(k[starts]), "n": pa.array(n[starts], pa.int64()),
        "hashes": pa.array([h[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
        "held": pa.array([held[a:b].astype("<i8").tobytes() for a, b in zip(starts, ends)], pa.binary())})


def _meeting(keyed: DataFrame, rows: int, percent: int, share: float, least: int) -> DataFrame:
    """``key, h``: for each class that may link, the rarest of its shared hashes, enough of them that classes that link meet on one."""
    hot = _hot(keyed, rows, share, least)
    total = keyed.agg(F.sum(F.length("prefix"))).first()[0] or 0
    bits = max(5, min(24, (total // 8 // RANGE).bit_length()))
    blocks, own_hot = _dealt(keyed, bits, hot)
    shared = blocks.groupBy("range").applyInArrow(_count_range, "key bigint, n bigint, hashes binary, held binary")
    if len(hot):
        shared = shared.unionByName(own_hot.distinct().withColumn("held", F.lit(None).cast("binary")))
    # one row a hash range at most, and one of hot hashes: bounded by the prefix of one set
    grouped = shared.groupBy("key").agg(F.max("n").alias("n"), F.collect_list(F.struct("hashes", "held")).alias("parts"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for key, n, parts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                h = np.concatenate([np.frombuffer(p["hashes"], np.uint64) for p in parts])
                # hot hashes come after all others, in the order of their values
                held = np.concatenate([np.frombuffer(p["held"], "<i8") if p["held"] is not None else np.full(len(p["hashes"]) // 8, 1 << 62) for p in parts])
                most = len(h) - shared_size(n, percent) + 1
                if most > 0:
                    out.append(h[np.lexsort((h, held))[:most]])
                    keys.append(np.full(len(out[-1]), key, dtype=np.int64))
            h = np.concatenate(out) if out else np.zeros(0, np.uint64)
            k = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(h.view(np.int64))], names=["key", "h"])

    return saved(map_arrow(grouped, choose, "key bigint, h bigint"), "jaccard-meeting")


def _blocks(meeting: DataFrame) -> DataFrame:
    """``key, block`` of the classes that meet another one."""
    first = meeting.groupBy("h").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("h", "least")
    edges = meeting.join(first, "h").select("key", "least").distinct()
    return connected_components(edges, "key", "least").select(F.col("node").alias("key"), F.col("component").alias("block"))


class Tree:
    """Sets of one tile in a hierarchy of nodes, leaves first.

    ``levels[l]`` has the OR-combined bitmaps, the least and greatest size, the
    greatest number of hashes hidden by bitmap collisions, and the component of
    each node (-1 where it has several); level 0 are the sets themselves."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, bits: int):
        self.sets, self.bits, self.labels = sets, bits, labels
        maps = np.zeros((len(sets), bits // 64), dtype=np.uint64)
        for row, s in zip(maps, sets):
            place = s & np.uint64(bits - 1)
            np.bitwise_or.at(row, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        hidden = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, hidden)]
        width = LEAF
        while len(self.levels[-1][1]) > 1:
            starts = np.arange(0, len(self.levels[-1][1]), width)
            m, low, high, hid = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(m, starts, axis=0), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(hid, starts)))
            width = FANOUT

    def components(self, level: int, labels: np.ndarray) -> np.ndarray:
        """The one component of each node, -1 where there are several."""
        low = high = labels
        width = LEAF
        for _ in range(level):
            starts = np.arange(0, len(low), width)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            width = FANOUT
        return np.where(low == high, low, -1)


def tree_bits(sizes: list[int]) -> int:
    """Bits of a bitmap: about eight for each hash of the largest set."""
    return 1 << max(9, min(20, (8 * max(sizes, default=1) - 1).bit_length()))


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Can any set under node ``i`` of level ``a`` link with any under node ``j`` of ``b``?"""
    (maps, low, high, hid), (maps2, low2, high2, hid2) = a, b
    fits = (100 * high[i] >= percent * low2[j]) & (100 * high2[j] >= percent * low[i])
    out = np.zeros(len(i), dtype=bool)
    some = np.flatnonzero(fits)
    step = max(1, (1 << 19) // maps.shape[1])
    for s in range(0, len(some), step):
        x = some[s:s + step]
        overlap = np.bitwise_count(maps[i[x]] & maps2[j[x]]).sum(axis=1, dtype=np.int64) + np.minimum(hid[i[x]], hid2[j[x]])
        overlap = np.minimum(overlap, np.minimum(high[i[x]], high2[j[x]]))
        least = np.maximum(percent * np.maximum(low[i[x]], low2[j[x]]) * (100 + percent), 100 * percent * (low[i[x]] + low2[j[x]]))
        out[x] = 100 * (100 + percent) * overlap >= least
    return out


def dual_links(one: Tree, two: Tree, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets of two trees (or of one
    with itself) beyond what their labels already join, as index pairs; the
    second tree's indexes follow the first's."""
    same = one is two
    n = len(one.sets)
    sets = one.sets if same else one.sets + two.sets
    labels = one.labels.copy() if same else np.concatenate([one.labels, two.labels])
    _, labels = np.unique(labels, return_inverse=True)
    found: list[tuple[int, int]] = []
    level = max(len(one.levels), len(two.levels)) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    # pairs of nodes still open; the shorter tree waits at its root
    while len(i):
        a, b = min(level, len(one.levels) - 1), min(level, len(two.levels) - 1)
        mine = one.components(a, labels[:n])
        theirs = mine if same else two.components(b, labels[n:])
        apart = (mine[i] < 0) | (mine[i] != theirs[j])
        i, j = i[apart], j[apart]
        possible = _possible(one.levels[a], two.levels[b], i, j, percent)
        i, j = i[possible], j[possible]
        if level == 0:
            break
        down_a, down_b = level <= len(one.levels) - 1, level <= len(two.levels) - 1
        width = LEAF if level == 1 else FANOUT
        i, j = _children(i, j, width if down_a else 1, width if down_b else 1, len(one.levels[level - 1][1]) if down_a else 1, len(two.levels[level - 1][1]) if down_b else 1)
        if same:
            i, j = i[i <= j], j[i <= j]
        level -= 1
    if same:
        i, j = i[i < j], j[i < j]
    else:
        j = j + n
    for s in range(0, len(i), 4096):
        x, y = i[s:s + 4096], j[s:s + 4096]
        left = np.flatnonzero(labels[x] != labels[y])
        for p, q in zip(x[left].tolist(), y[left].tolist()):
            if labels[p] != labels[q] and linked(sets[p], sets[q], percent):
                found.append((p, q))
                labels[labels == labels[q]] = labels[p]
    return found


def _children(i: np.ndarray, j: np.ndarray, wide_a: int, wide_b: int, most_a: int, most_b: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the open pairs of nodes."""
    a = (i[:, None, None] * wide_a + np.arange(wide_a)[:, None]) + np.zeros(wide_b, np.int64)
    b = (j[:, None, None] * wide_b + np.arange(wide_b)) + np.zeros((wide_a, 1), np.int64)
    a, b = a.reshape(-1), b.reshape(-1)
    there = (a < most_a) & (b < most_b)
    return a[there], b[there]


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """``100 * intersection >= percent * union`` of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _cut(hashes: bytes, sizes: list[int]) -> list[np.ndarray]:
    flat = np.frombuffer(hashes, np.uint64)
    ends = np.cumsum(sizes)
    return [flat[e - s:e] for s, e in zip(sizes, ends)]


def _pack_tile(table: pa.Table) -> pa.Table:
    """Rows of one tile to one row, in the order of their smallest hashes."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["hashes"][:8][::-1], r["key"]))
    return pa.table({
        "block": pa.array([rows[0]["block"]], pa.int64()), "grade": pa.array([rows[0]["grade"]], pa.int32()), "tile": pa.array([rows[0]["tile"]], pa.int64()),
        "keys": pa.array([[r["key"] for r in rows]], pa.list_(pa.int64())), "sizes": pa.array([[len(r["hashes"]) // 8 for r in rows]], pa.list_(pa.int64())),
        "hashes": pa.array([b"".join(r["hashes"] for r in rows)], pa.binary())})


_TILE_SCHEMA = "block bigint, grade int, tile bigint, keys array<bigint>, sizes array<bigint>, hashes binary"


def _tiles(docs: DataFrame, classes: DataFrame, blocks: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The classes of all blocks, packed in tiles."""
    members = saved(classes.join(blocks, "key").select("key", "block", "text_key", "n"), "jaccard-members")
    texts = docs.select(F.unhex(F.md5(F.col("text").cast("string").cast("binary"))).alias("text_key"), F.col("text").cast("string").cast("binary").alias("text"))
    count = members.count()
    texts = texts.join(broadcast_if_small(members.select("text_key"), count, KEYS_BROADCAST), "text_key", "left_semi")
    texts = texts.groupBy("text_key").agg(F.min("text").alias("text"))  # copies meet once a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column(1).to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([int(s[0].view(np.int64)) if len(s) else 0 for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["text_key", "least", "hashes"])

    sets = map_arrow(texts, run, "text_key binary, least bigint, hashes binary")
    # sizes that can link differ by one grade at most
    grade = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) * 1.000001)).cast("int")
    full = saved(members.withColumn("grade", grade).join(sets, "text_key"), "jaccard-sets")
    placed = with_rank(full.select("key", "block", "grade", "n", "least"), [F.asc("block"), F.asc("grade"), F.asc("least"), F.asc("key")], "jaccard-places")
    starts = placed.groupBy("block", "grade").agg(F.min("rank").alias("first"), F.max("n").alias("longest"))
    capacity = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(TILE_HASHES) / F.col("longest"))))
    placed = placed.join(starts, ["block", "grade"]).select("key", F.floor((F.col("rank") - F.col("first")) / capacity).alias("tile"))
    whole = full.select("key", "block", "grade", "hashes").join(placed, "key")
    return saved(whole.groupBy("block", "grade", "tile").applyInArrow(_pack_tile, _TILE_SCHEMA), "jaccard-tiles")


def _own_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sets = _cut(row["hashes"], row["sizes"])
                tree = Tree(sets, np.arange(len(sets)), tree_bits(row["sizes"]))
                yield _edges([(row["keys"][a], row["keys"][b]) for a, b in dual_links(tree, tree, percent)])

    return run


def _cross_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bits = tree_bits(row["sizes"] + row["sizes2"])
                one = Tree(_cut(row["hashes"], row["sizes"]), np.array(row["labels"], np.int64), bits)
                two = Tree(_cut(row["hashes2"], row["sizes2"]), np.array(row["labels2"], np.int64), bits)
                keys = row["keys"] + row["keys2"]
                yield _edges([(keys[a], keys[b]) for a, b in dual_links(one, two, percent)])

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*pairs) if pairs else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _with_labels(tiles: DataFrame, links: DataFrame) -> DataFrame:
    """``tiles`` of blocks of several tiles, the components of their keys so far, and the least and greatest of them."""
    known = connected_components(links, "u", "v")
    keys = tiles.select("block", "grade", "tile", F.posexplode("keys").alias("place", "key"))
    labels = keys.join(known, F.col("key") == F.col("node"), "left") \
        .groupBy("block", "grade", "tile").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("component", "key").alias("label")))).label.alias("labels"))
    labels = labels.withColumn("low", F.array_min("labels")).withColumn("high", F.array_max("labels"))
    return saved(tiles.join(labels, ["block", "grade", "tile"]), "jaccard-labelled")


def _cross(tiles: DataFrame, links: DataFrame, hubs: bool, percent: int) -> DataFrame:
    """Links between tiles of a block: each with the first of its grade and the next grade (``hubs``), or all others."""
    labelled = _with_labels(tiles, links)
    heads = labelled.select("block", "grade", "tile", "low", "high")
    two = heads.select("block", *(F.col(c).alias(f"{c}2") for c in ("grade", "tile", "low", "high")))
    pairs = heads.join(two, "block").where(
        ((F.col("grade2") == F.col("grade")) & (F.col("tile2") > F.col("tile"))) | (F.col("grade2") == F.col("grade") + 1))
    is_hub = (F.col("tile") == 0) | (F.col("tile2") == 0)
    # tiles that lie in one and the same component have nothing to add
    pairs = pairs.where(is_hub if hubs else ~is_hub).where(~((F.col("low") == F.col("high")) & (F.col("low2") == F.col("high2")) & (F.col("low") == F.col("low2"))))
    pairs = pairs.select("block", "grade", "tile", "grade2", "tile2")
    right = labelled.select("block", *(F.col(c).alias(f"{c}2") for c in ("grade", "tile", "keys", "sizes", "hashes", "labels")))
    pairs = pairs.join(labelled.drop("low", "high"), ["block", "grade", "tile"]).join(right, ["block", "grade2", "tile2"])
    pairs = pairs.select("keys", "sizes", "hashes", "labels", "keys2", "sizes2", "hashes2", "labels2")
    return saved(map_arrow(pairs.repartition(F.xxhash64("keys", "keys2")), _cross_links(percent), "u bigint, v bigint"), "jaccard-cross")


def class_links(docs: DataFrame, keyed: DataFrame, classes: DataFrame, shingle: int, percent: int, share: float, least: int) -> DataFrame:
    """``u, v``: class keys; a spanning forest of every component of linked classes."""
    meeting = _meeting(keyed, keyed.count(), percent, share, least)
    tiles = _tiles(docs, classes, _blocks(meeting), shingle, percent)
    links = saved(map_arrow(tiles, _own_links(percent), "u bigint, v bigint"), "jaccard-own")
    large = tiles.groupBy("block").agg(F.count("*").alias("tiles")).where("tiles > 1").select("block")
    several = saved(tiles.join(large, "block", "left_semi"), "jaccard-several")
    if several.isEmpty():
        return links
    for hubs in (True, False):
        links = saved(links.unionByName(_cross(several, links, hubs, percent)), "jaccard-links")
    return links


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, hot_share: float = HOT_SHARE, hot_least: int = HOT_LEAST) -> DataFrame:
    """Per document: ``doc_id, n_shingles, class_id`` (hex digest of the set, null if empty) and ``component_id``."""
    if not 50 <= percent < 100:
        raise ValueError("percent is 50 to 99")
    ship_package(docs.sparkSession)
    keyed = saved(_keyed(docs, shingle, percent), "jaccard-keyed")
    classes = keyed.where("n > 0").groupBy("digest", "key").agg(F.min("text_key").alias("text_key"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.max("n").alias("n"))
    classes = saved(classes, "jaccard-classes")
    links = class_links(docs, keyed, classes, shingle, percent, hot_share, hot_least)
    roots = connected_components(links, "u", "v").select(F.col("node").alias("key"), F.col("component").alias("root"))
    rooted = saved(classes.join(roots, "key", "left").where("root is not null or copies > 1").withColumn("root", F.coalesce("root", "key")), "jaccard-roots")
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(names, "root").select("digest", "component_id", F.lit(True).alias("grouped"))
    named = broadcast_if_small(named, rooted.count(), KEYS_BROADCAST // 4)
    empty = F.col("n") == 0
    return keyed.select("doc_id", "digest", "n").join(named, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(~empty, F.lower(F.hex("digest"))).alias("class_id"),
        F.when(F.col("grouped") & ~empty, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
