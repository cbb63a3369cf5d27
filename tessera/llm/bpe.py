"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 32 bytes cuts each text into chunks at places that depend on
the content alone, so copies and shared passages give the same chunks.
Documents are dealt out by the smallest chunk hash (rebalanced, so that a large
group of copies spreads over several tasks), and a task encodes each distinct
chunk once while it stays in a bounded cache.

Joins are repaired: a blank between two solid characters is a token boundary
whatever stands around it.  Of a chunk's ids only those between its first and
last such blank are taken, after a check that its own encoding has boundaries
there.  The text between the last agreed place of one chunk and the first
agreed place of the next is encoded anew; if a chunk has no agreed place the
re-encoded stretch goes on to the next chunk, in the end to the whole text.  So
the ids are always those of the whole text.

Null counts as empty (no ids).  Ids and texts of any length, repeated rows and
extra columns are allowed; the result has one row per input row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, whole
from .tokens import check_byte_level, encoder

WINDOW = 32
#: A chunk has about this many bytes.
CHUNK = 1024
CACHE_BYTES = 24 << 20
#: Random value of each byte, from a fixed generator.
GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the last ``WINDOW`` bytes at each place: the sum of ``GEAR[byte] << age``, by doubling the window."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint32(step) if len(h) > step else 0
        h = h + older
        step *= 2
    return h


def cut_places(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all chunks of the texts that lie one after another in ``data``
    (a text's start is a chunk's start), and the rolling hashes."""
    h = rolling_hash(data)
    hit = (h >> np.uint32(12)) % np.uint32(CHUNK) == 0
    hit &= (data & 0xC0) != 0x80  # before the first byte of a character
    starts = np.concatenate([[0], ends[:-1]])
    near = starts[:, None] + np.arange(WINDOW)[None, :]
    hit[np.unique(near[near < np.minimum(starts + WINDOW, ends)[:, None]])] = False  # the window would reach into another text
    return np.union1d(np.flatnonzero(hit), starts[starts < ends]), h


def solid_blanks(data: np.ndarray) -> np.ndarray:
    """Places of blanks between two characters that are surely not white space."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    ascii_solid = (data > 32) & (data < 127)
    lead = ((data >= 0xC3) & (data <= 0xDF)) | (data >= 0xE4)
    before = ascii_solid.copy()  # the byte ends a solid character
    before[1:] |= ((data[1:] & 0xC0) == 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    blank = data == 32
    blank[1:-1] &= before[:-2] & (ascii_solid | lead)[2:]
    blank[[0, -1]] = False
    return np.flatnonzero(blank)


def sketch(text: bytes) -> int:
    """Smallest hash of a chunk start: the same for most near copies."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return 0
    starts, h = cut_places(data, np.array([len(data)]))
    return int(h[starts[1:]].min()) if len(starts) > 1 else int.from_bytes(hashlib.blake2b(text, digest_size=4).digest(), "little")


class ChunkEncoder:
    """Encodes batches of texts and keeps the ids of chunks seen before."""

    def __init__(self, path: str):
        self.units = encoder(path)
        self.kept: dict[bytes, tuple[int, int, np.ndarray]] = {}
        self.size = 0
        self.encoded = self.reused = 0

    def _add(self, chunks: list[bytes], first: list[int], last: list[int]) -> None:
        """Encode chunks and keep, of each, the ids between its first and last solid blank."""
        ids, counts = self.units.encode([c.decode() for c in chunks])
        sizes = self.units.token_bytes()[2]
        ends = np.cumsum(counts)
        for chunk, a, b, start, end in zip(chunks, first, last, (ends - counts).tolist(), ends.tolist()):
            own = ids[start:end]
            bound = np.concatenate([[0], np.cumsum(sizes[own])])
            i, j = np.searchsorted(bound, [a, b])
            agreed = 0 <= a < b and bound[i] == a and bound[j] == b
            self.kept[chunk] = (a, b, own[i:j].copy()) if agreed else (-1, -1, own[:0])
            self.size += len(chunk) * 3 + 200
        self.encoded += len(chunks)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each."""
        raw = b"".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if self.size > CACHE_BYTES:
            self.kept.clear()
            self.size = 0
        data = np.frombuffer(raw, np.uint8)
        starts, _ = cut_places(data, ends)
        stops = np.append(starts[1:], len(data))
        blanks = solid_blanks(data)
        # both neighbours of a place lie inside the chunk, so that it depends on the chunk alone
        lo, hi = np.searchsorted(blanks, starts + 4), np.searchsorted(blanks, stops - 2, side="right") - 1
        some = hi > lo
        at = np.append(blanks, 0)
        first = np.where(some, at[np.minimum(lo, len(blanks))] - starts, -1).tolist()
        last = np.where(some, at[np.maximum(hi, 0)] - starts, -1).tolist()
        starts, stops = starts.tolist(), stops.tolist()
        chunks = [raw[a:b] for a, b in zip(starts, stops)]
        new = {c: k for k, c in enumerate(chunks) if c not in self.kept and first[k] >= 0}
        self._add(list(new), [first[k] for k in new.values()], [last[k] for k in new.values()])
        self.reused += len(chunks) - len(new)
        # alternate stretches to encode anew and kept ids, text by text
        seams: list[str] = []
        parts: list[np.ndarray | int] = []
        text_of: list[int] = []
        k = 0
        for i, end in enumerate(ends.tolist()):
            done = end - int(lengths[i])
            while k < len(chunks) and starts[k] < end:
                a, b, own = self.kept.get(chunks[k], (-1, -1, None)) if first[k] >= 0 else (-1, -1, None)
                if a >= 0:
                    parts += [len(seams), own]
                    text_of += [i, i]
                    seams.append(raw[done:starts[k] + a].decode())
                    done = starts[k] + b
                k += 1
            if done < end:
                parts.append(len(seams))
                text_of.append(i)
                seams.append(raw[done:end].decode())
        again, n = self.units.encode(seams)
        stop = np.cumsum(n)
        out = [again[stop[p] - n[p]:stop[p]] if isinstance(p, int) else p for p in parts]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        counts = np.bincount(np.array(text_of, dtype=np.int64), weights=sizes, minlength=len(texts)).astype(np.int64)
        return np.concatenate(out) if out else np.zeros(0, np.uint32), counts


def deal_by_content(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and the text (as ``_b_text``, null as empty) with copies and near copies side by side."""
    d = docs.select(*columns, whole().alias("_b_text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            key = pa.array([sketch(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, key], names=[*batch.schema.names, "_b_key"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields)
    return map_arrow(d, run, f"{schema}, _b_key bigint").hint("rebalance", F.col("_b_key")).drop("_b_key")


def encode_documents(docs: DataFrame, path: str, columns: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Per document the ``columns`` (default ``doc_id``), ``n_tokens``, ``ids``
    (little-endian unsigned 32-bit integers, if ``with_ids``), the hash of the
    ids and the hash of the text decoded from them."""
    check_byte_level(path)
    columns = ["doc_id"] if columns is None else columns
    d = deal_by_content(docs, columns)

    def run(batches):
        chunked = ChunkEncoder(path)
        for batch in batches:
            for part in slices(batch, "_b_text"):
                texts = [t.encode() for t in part.column(part.num_columns - 1).to_pylist()]
                ids, counts = chunked.encode(texts)
                back = chunked.units.decode(ids, counts)
                raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                own = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]
                out = [*part.columns[:len(columns)], pa.array(counts, pa.int64()), *([pa.array(own, pa.binary())] if with_ids else []),
                       pa.array([hashlib.sha256(x).hexdigest() for x in own]), pa.array([hashlib.sha256(x).hexdigest() for x in back])]
                yield pa.RecordBatch.from_arrays(out, names=names)

    names = [*columns, "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields if f.name in columns)
    return map_arrow(d, run, f"{schema}, n_tokens bigint, {'ids binary, ' if with_ids else ''}ids_sha256 string, decoded_sha256 string")
