"""Token files: ids in canonical length-limited Huffman code.

Layout of a folder:

* ``codebook`` (Parquet): ``id, length`` of every id that occurs.  Code words are
  canonical: ordered by length, then id.
* ``shards`` (Parquet, directories ``shard=k`` in ascending ranges of ``doc_id``,
  rows ascending within): ``doc_id, first`` (ids of the shard before the
  document), ``n_tokens, payload``.
* ``offsets`` (Parquet): ``shard, offset`` (ids in all shards before).

A payload is a row of independent blocks of at most ``BLOCK`` ids, each
``u32 ids, u32 bytes, u32 bit offset of every STRIDE-th id after the first,
bits`` (little-endian; the bits start at the high end of a byte and end on a
whole byte).  Any block decodes alone, and from any checkpoint in it.

Code lengths come from the counts over all documents, limited to 16 bits (or
what so many ids need) by package-merge.  Decoding looks up the next bits in one
table and advances all checkpoints of a batch in step.

Null text counts as empty; each document ends with the id ``END``.  Documents
with a null id come first.  Rows with equal ids are ordered by the hash of their
ids.  Extra columns are ignored.  An empty table gives empty files and no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path
from .common import map_arrow, slices
from .tokens import check_byte_level, encoder

END = 0
BLOCK = 8192
STRIDE = 256
LIMIT = 16
#: Ids in a shard, and the least and largest number of shards.
SHARD_IDS = 8_000_000
SHARDS = 64, 20_000


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    if n > 1 << limit:
        raise ValueError("more symbols than code words of that length")
    order = np.argsort(counts, kind="stable")
    leaf = np.asarray(counts, dtype=np.int64)[order]
    kinds = []  # of each level: whether the items in ascending order are leaves
    weights = np.zeros(0, dtype=np.int64)
    for _ in range(limit):
        pairs = weights[:len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaf, pairs])
        by = np.argsort(merged, kind="stable")
        kinds.append(by < n)
        weights = merged[by]
    lengths = np.zeros(n, dtype=np.int64)
    take = 2 * n - 2
    for kind in reversed(kinds):
        leaves = int(kind[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code of ids (ascending) with given lengths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.width = int(lengths.max()) if len(lengths) else 1
        size = int(ids.max()) + 1 if len(ids) else 1
        self.length, self.word = np.zeros(size, np.int64), np.zeros(size, np.int64)
        order = np.lexsort((ids, lengths))
        steps = 1 << (self.width - lengths[order])  # share of the table that a word covers
        firsts = np.cumsum(steps) - steps
        self.length[ids] = lengths
        self.word[ids[order]] = firsts >> (self.width - lengths[order])
        covered = int(steps.sum())
        self.table_id = np.zeros(1 << self.width, np.uint32)
        self.table_id[:covered] = np.repeat(ids[order], steps)
        self.table_length = np.ones(1 << self.width, np.int64)
        self.table_length[:covered] = np.repeat(lengths[order], steps)

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Payload of each run of ids."""
        per = -(-counts // BLOCK)
        n_blocks = int(per.sum())
        if not n_blocks:
            return [b""] * len(counts)
        within = np.arange(n_blocks) - np.repeat(np.cumsum(per) - per, per)
        block_ids = np.minimum(BLOCK, np.repeat(counts, per) - within * BLOCK)
        starts = np.cumsum(block_ids) - block_ids
        length = self.length[ids]
        bits = np.cumsum(length) - length
        stop = bits[starts + block_ids - 1] + length[starts + block_ids - 1]
        block_bytes = (stop - bits[starts] + 7) // 8
        base = np.cumsum(block_bytes) - block_bytes
        place = bits - np.repeat(bits[starts], block_ids) + np.repeat(base * 8, block_ids)
        total = int(block_bytes.sum())
        shifted = self.word[ids] << (32 - length - (place & 7))
        at = place >> 3
        heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        summed = np.add.reduceat(shifted, heads)  # code words do not overlap, so a sum is their union
        out = np.zeros(total + 4, dtype=np.int64)
        for k in range(4):
            out[at[heads] + k] += (summed >> (24 - 8 * k)) & 255
        raw = out[:total].astype(np.uint8).tobytes()
        relative = (place - np.repeat(base * 8, block_ids)).astype("<u4")
        blocks = []
        for s, n, a, size in zip(starts.tolist(), block_ids.tolist(), base.tolist(), block_bytes.tolist()):
            head = np.array([n, size], dtype="<u4").tobytes()
            blocks.append(head + relative[s + STRIDE:s + n:STRIDE].tobytes() + raw[a:a + size])
        payloads, a = [], 0
        for k in per.tolist():
            payloads.append(b"".join(blocks[a:a + k]))
            a += k
        return payloads

    def decode(self, payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all payloads in one array, and the number of ids of each."""
        bodies, places, runs, counts, base = [], [], [], [], 0
        for payload in payloads:
            a, total = 0, 0
            while a < len(payload):
                n, size = np.frombuffer(payload, "<u4", 2, a).tolist()
                marks = (n - 1) // STRIDE
                places.append(np.concatenate([[0], np.frombuffer(payload, "<u4", marks, a + 8)]).astype(np.int64) + 8 * base)
                run = np.full(marks + 1, STRIDE, dtype=np.int64)
                run[-1] = n - marks * STRIDE
                runs.append(run)
                a += 8 + 4 * marks
                bodies.append(payload[a:a + size])
                a += size
                base += size
                total += n
            counts.append(total)
        if not bodies:
            return np.zeros(0, np.uint32), np.array(counts, dtype=np.int64)
        data = np.frombuffer(b"".join([*bodies, b"\0" * 4]), np.uint8).astype(np.uint32)
        ahead = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        place, run = np.concatenate(places), np.concatenate(runs)
        first = np.cumsum(run) - run
        order = np.argsort(-run, kind="stable")  # those still running are always in front
        place, first, run = place[order], first[order], run[order]
        out = np.empty(int(run.sum()), dtype=np.uint32)
        running = np.searchsorted(-run, -np.arange(1, int(run[0]) + 1), side="right")
        mask, shift = (1 << self.width) - 1, 32 - self.width
        for step, k in enumerate(running.tolist()):
            at = place[:k]
            bits = (ahead[at >> 3] >> (shift - (at & 7)).astype(np.uint32)) & np.uint32(mask)
            out[first[:k] + step] = self.table_id[bits]
            place[:k] = at + self.table_length[bits]
        return out, np.array(counts, dtype=np.int64)


def _code(book: list) -> Code:
    """Code of codebook rows (at most one for each id of the vocabulary)."""
    rows = sorted((r["id"], r["length"]) for r in book)
    return Code(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64))


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` (with the end id; 16 bits each where the vocabulary allows it)."""
    kind = "<u2" if check_byte_level(path) <= 1 << 16 else "<u4"

    def run(batches):
        own = encoder(path)
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                ids, counts = own.encode(part.column(1).to_pylist())
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, END).astype(kind).tobytes()
                stops = (ends + np.arange(1, len(ends) + 1)) * int(kind[2])
                own_ids = [ids[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts + 1, pa.int64()), pa.array(own_ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    d = docs.select("doc_id", "text")
    return map_arrow(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids binary")


def id_counts(tokens: DataFrame, kind: str) -> DataFrame:
    """``id, n`` over all documents, summed up in each task first."""

    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "ids", 8 << 20):
                found = np.bincount(np.frombuffer(b"".join(part.column(0).to_pylist()), kind))
                if len(found) > len(total):
                    total, found = found.astype(np.int64), total
                total[:len(found)] += found
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "n"])

    return map_arrow(tokens.select("ids"), run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, tokenizer: str, folder: str) -> None:
    """Encode all documents and write them to ``folder``."""
    kind = "<u2" if check_byte_level(tokenizer) <= 1 << 16 else "<u4"
    spark = docs.sparkSession
    scratch = scratch_path(spark, "tokens")
    tokenized(docs, tokenizer).write.option("compression", "zstd").parquet(scratch)
    tokens = spark.read.parquet(scratch)
    counted = id_counts(tokens, kind).collect()  # bounded by the vocabulary
    counted = sorted((r["id"], r["n"]) for r in counted)
    limit = max(LIMIT, max(len(counted) - 1, 1).bit_length())
    lengths = code_lengths(np.array([n for _, n in counted], dtype=np.int64), limit).tolist()
    book = [(i, k) for (i, _), k in zip(counted, lengths)]
    spark.createDataFrame(book, "id bigint, length bigint").coalesce(1).write.parquet(f"{folder}/codebook")
    code = spark.sparkContext.broadcast([{"id": i, "length": k} for i, k in book])  # a row for each id at most

    total = sum(n for _, n in counted)
    n_shards = min(max(SHARDS[0], total // SHARD_IDS), SHARDS[1])
    bounds = tokens.approxQuantile("doc_id", [k / n_shards for k in range(1, n_shards)], 0.1 / n_shards) if total else []
    bounds = sorted({int(b) for b in bounds})  # at most SHARDS[1] numbers

    def pack(batches):
        own = _code(code.value)
        for batch in batches:
            for part in slices(batch, "ids"):
                ids = np.frombuffer(b"".join(part.column(2).to_pylist()), kind)
                payloads = own.encode(ids, part.column(1).to_numpy(zero_copy_only=False))
                shard = [0 if i is None else bisect_right(bounds, i) for i in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), part.column(0), part.column(1), part.column(3), pa.array(payloads, pa.binary())], names=["shard", "doc_id", "n_tokens", "tie", "payload"])

    doc_id = tokens.schema["doc_id"].dataType.simpleString()
    packed = map_arrow(tokens.select("doc_id", "n_tokens", "ids", F.xxhash64("ids").alias("tie")), pack,
                       f"shard int, doc_id {doc_id}, n_tokens bigint, tie bigint, payload binary")
    ordered = packed.repartition("shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "tie")

    def number(batches):
        shard, done = None, 0
        for batch in batches:
            own, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            first = np.empty(len(n), dtype=np.int64)
            for s in dict.fromkeys(own.tolist()):
                some = np.flatnonzero(own == s)
                done = done if s == shard else 0
                ends = np.cumsum(n[some])
                first[some] = done + ends - n[some]
                shard, done = s, done + int(ends[-1])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(first, pa.int64()), batch.column(2), batch.column(4), batch.column(0)], names=["doc_id", "first", "n_tokens", "payload", "shard"])

    numbered = map_arrow(ordered, number, f"doc_id {doc_id}, first bigint, n_tokens bigint, payload binary, shard int")
    numbered.write.partitionBy("shard").option("compression", "none").parquet(f"{folder}/shards")
    sizes = _shards(spark, folder, doc_id).groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # at most SHARDS[1] rows
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes.select("shard", before.alias("offset")).write.parquet(f"{folder}/offsets")


def _shards(spark: SparkSession, folder: str, doc_id: str) -> DataFrame:
    return spark.read.schema(f"doc_id {doc_id}, first bigint, n_tokens bigint, payload binary, shard int").parquet(f"{folder}/shards")


def read_ids(spark: SparkSession, folder: str, doc_id: str = "bigint", with_ids: bool = True) -> DataFrame:
    """Per document of the files: ``doc_id, start`` (ids of all documents before
    it), ``n_tokens``, ``ids`` (little-endian 32-bit, if ``with_ids``) and ``ids_crc32``, all from decoded payloads."""
    code = spark.sparkContext.broadcast(spark.read.parquet(f"{folder}/codebook").collect())  # a row for each id at most

    def unpack(batches):
        own = _code(code.value)
        for batch in batches:
            for part in slices(batch, "payload", 2 << 20):
                ids, counts = own.decode(part.column(3).to_pylist())
                raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                runs = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]
                out = [part.column(0), part.column(1), part.column(2), pa.array(counts, pa.int64()), *([pa.array(runs, pa.binary())] if with_ids else []),
                       pa.array([zlib.crc32(x) for x in runs], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["shard", "doc_id", "first", "n_tokens", *(["ids"] if with_ids else []), "ids_crc32"]
    rows = map_arrow(_shards(spark, folder, doc_id).select("shard", "doc_id", "first", "payload"), unpack,
                     f"shard int, doc_id {doc_id}, first bigint, n_tokens bigint, {'ids binary, ' if with_ids else ''}ids_crc32 bigint")
    offsets = F.broadcast(spark.read.parquet(f"{folder}/offsets"))  # at most SHARDS[1] rows
    return rows.join(offsets, "shard").select("doc_id", (F.col("offset") + F.col("first")).alias("start"), *names[3:])


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """Write the files (to a new folder of the shared checkpoint directory by default) and read them back."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = scratch_path(spark, "token-files") if folder is None else folder
    write_ids(docs, tokenizer, folder)
    return read_ids(spark, folder, docs.schema["doc_id"].dataType.simpleString(), with_ids)

