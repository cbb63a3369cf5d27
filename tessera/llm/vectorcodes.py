"""Product-quantised vector codes by exact k-means over Hilbert-sorted blocks.

Components become integers, ``floor(4096 * x)``.  Vectors are gathered into
tiles of bounded size inside their own scan task (no shuffle, so no key can be
hot).  In a tile, each part position's sub-vectors are sorted along a Hilbert
curve and cut into flat blocks of ``BLOCK`` rows that store their min/max box,
their sums and their size.  The tiles are written once; a round reads them with
the current codebooks (``entries * width`` integers, whatever the number of
vectors) in the task's closure.  A block's shortlist comes from its box: an entry is left
out where the entry nearest to the box's middle has the smaller distance in the
whole box (the difference of two squared distances is linear, so its greatest
value over a box is exact).  Ties stay listed, so the nearest entry with the
lowest index is always on the list.  A block with one entry on its list hands
over its stored sums; the others compare their rows with the listed entries
only, in integer arithmetic.  A tile's partial sums are added up by Spark and at
most ``entries * (width + parts)`` totals reach the driver.

Defined cases.  Vectors that are null or hold a null or non-finite component
are dropped.  Vectors shorter than the longest, and lengths that the number of
parts does not divide, count as padded with zeros at the end (an empty vector is
all zeros).  The first entries are those of the smallest ids; a null id comes
after all others, equal ids go by their components.  Fewer vectors than entries
make smaller codebooks; an empty table gives an empty result.  Repeated rows are
rows of their own.  Components of any finite size are exact: where 64 bits do
not hold a squared distance, Python integers do; an ``error`` beyond 64 bits is
null and so is the ``label_error`` of its label.  Null labels count together.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, map_arrow, saved

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK = 8
#: Rows and components of a tile at most; both bound a task's memory.
TILE_ROWS = 32_768
TILE_COMPONENTS = 1 << 21
LABELS_BROADCAST = 10_000
#: Sums travel in limbs of so many bits, since a sum of wide integers fits no SQL type.
LIMB_BITS = 60

Books = list[list[list[int]]]


def whole_numbers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)``: 64-bit integers where they fit, else Python integers."""
    if not x.size or np.abs(x).max() < 2.0 ** 62 / scale:
        return np.floor(x * scale).astype(np.int64)
    out = np.empty(x.shape, dtype=object)
    for i, v in np.ndenumerate(x):
        out[i] = int(v) * scale if abs(v) >= 2.0 ** 52 else math.floor(float(v) * scale)
    return out


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Places on a Hilbert curve through the box of ``points`` (rows), at most 62 bits.

    Transposed-axes form: undo excess work from the highest bit down, Gray-code
    the axes, interleave their bits.  Only the order depends on it, so points
    with more than 62 axes go by their first 62."""
    axes = min(points.shape[1], 62)
    bits = max(1, min(8, 62 // max(axes, 1)))
    p = points[:, :axes].astype(float)
    low = p.min(axis=0)
    span = np.maximum(p.max(axis=0) - low, 1e-300)
    x = np.minimum((p - low) / span * (1 << bits), (1 << bits) - 1).astype(np.int64)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(axes):
            hit = (x[:, i] & q) != 0
            t = np.where(hit, 0, (x[:, 0] ^ x[:, i]) & (q - 1))
            x[:, 0] ^= np.where(hit, q - 1, t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), dtype=np.int64)
    q = top
    while q > 1:
        t ^= np.where((x[:, axes - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def make_blocks(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Sub-vectors of one part position in Hilbert order, cut into blocks (the last one padded with its last row), and the order."""
    order = np.argsort(hilbert_keys(values), kind="stable")
    full = np.concatenate([order, np.repeat(order[-1:], -len(order) % block)])
    return values[full].reshape(-1, block, values.shape[1]), order


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each block (row) and entry (column): can the entry be the nearest of any point in the block's box?"""
    middle = (low + high) // 2
    apart = middle[:, None] - book
    chief = book[(apart * apart).sum(axis=-1).argmin(axis=1)][:, None]
    toward = chief - book
    corner = np.where(toward > 0, low[:, None], high[:, None])  # where the chief entry does worst against the other
    return (toward * (chief + book - 2 * corner)).sum(axis=-1) >= 0


def nearest(blocks: np.ndarray, short: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, over its block's shortlist; ties to the lower index."""
    shape = blocks.shape[:2]
    at = np.full(shape, -1, dtype=np.int16)
    best = np.zeros(shape, dtype=blocks.dtype)
    for k in range(len(book)):
        some = np.flatnonzero(short[:, k])
        if len(some):
            d = blocks[some] - book[k]
            d = (d * d).sum(axis=-1, dtype=blocks.dtype)
            better = (at[some] < 0) | (d < best[some])
            best[some] = np.where(better, d, best[some])
            at[some] = np.where(better, k, at[some])
    return at, best


def _kernel_type(bound: int, width: int):
    """The narrowest integers for squared distances, and their differences, over ``width`` components up to ``bound``."""
    most = 8 * bound * bound * max(width, 1)
    return np.int32 if most < 1 << 31 else np.int64 if most < 1 << 62 else object


def _tiles(width: int, parts: int, scale: int, id_type: pa.DataType, label_type: pa.DataType):
    """Function for ``mapInArrow``: rows (id, label, v) to tiles."""
    step = width // parts
    most = max(1, min(TILE_ROWS, TILE_COMPONENTS // max(width, 1)))
    names = ["n", "wide", "bound", "rows", "places", "low", "high", "sums", "ids", "labels"]

    def tile(ids: list, labels: list, x: np.ndarray) -> pa.RecordBatch:
        numbers = whole_numbers(x, scale)
        bound = max(int(abs(numbers).max()), 1) if numbers.size else 1
        wide = bound >= 1 << 31
        rows, places, low, high, sums = [], [], [], [], []
        for p in range(parts):
            blocks, order = make_blocks(numbers[:, p * step:(p + 1) * step].reshape(len(x), step))
            places.append(order.astype("<i4").tobytes())
            if wide:  # the plain components; boxes and sums of wide integers are made anew when read
                rows.append(x[order, p * step:(p + 1) * step].astype("<f8").tobytes())
            else:
                filled = np.arange(blocks.shape[0] * blocks.shape[1]).reshape(blocks.shape[:2]) < len(x)
                rows.append(blocks.astype("<i4").tobytes())
                low.append(blocks.min(axis=1).astype("<i4").tobytes())
                high.append(blocks.max(axis=1).astype("<i4").tobytes())
                sums.append((blocks * filled[:, :, None]).sum(axis=1).astype("<i8").tobytes())
        one = lambda items: pa.array([b"".join(items)], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([len(x)], pa.int32()), pa.array([wide]), pa.array([float(bound)]), one(rows), one(places), one(low), one(high), one(sums),
             pa.array([ids], pa.list_(id_type)), pa.array([labels], pa.list_(label_type))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, xs, n = [], [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                lists = part.column(2)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                x = np.zeros((len(sizes), width))
                inside = np.arange(width) < sizes[:, None]
                x[inside] = lists.flatten().to_numpy(zero_copy_only=False)
                if n and n + len(x) > most:
                    yield tile(ids, labels, np.concatenate(xs))
                    ids, labels, xs, n = [], [], [], 0
                ids += part.column(0).to_pylist()
                labels += part.column(1).to_pylist()
                xs.append(x)
                n += len(x)
        if n:
            yield tile(ids, labels, np.concatenate(xs))

    return run


def _opened(row: dict, part: int, parts: int, step: int, kind, scale: int) -> tuple[np.ndarray, ...]:
    """Blocks, boxes, sums and sizes of one part position of a stored tile."""
    n = row["n"]
    n_blocks = -(-n // BLOCK)
    sizes = np.minimum(n - BLOCK * np.arange(n_blocks), BLOCK)
    if row["wide"]:
        x = np.frombuffer(row["rows"], "<f8").reshape(parts, n, step)[part]
        x = np.concatenate([x, np.repeat(x[-1:], -n % BLOCK, axis=0)])
        blocks = whole_numbers(x, scale).astype(object).reshape(n_blocks, BLOCK, step)
        filled = (np.arange(n_blocks * BLOCK).reshape(n_blocks, BLOCK) < n).astype(object)
        return blocks, blocks.min(axis=1), blocks.max(axis=1), (blocks * filled[:, :, None]).sum(axis=1), sizes
    blocks = np.frombuffer(row["rows"], "<i4").reshape(parts, n_blocks, BLOCK, step)[part].astype(kind)
    low, high = (np.frombuffer(row[c], "<i4").reshape(parts, n_blocks, step)[part].astype(kind) for c in ("low", "high"))
    sums = np.frombuffer(row["sums"], "<i8").reshape(parts, n_blocks, step)[part]
    return blocks, low, high, sums.astype(object) if kind is object else sums, sizes


def _kind(row: dict, books: Books, width: int):
    most = max([abs(c) for book in books for entry in book for c in entry], default=1)
    return object if row["wide"] else _kernel_type(max(int(row["bound"]), most, 1), width)


def _limbs(value: int) -> list[int]:
    out = []
    while not -(1 << 62) <= value < 1 << 62:
        out.append(value & ((1 << LIMB_BITS) - 1))
        value >>= LIMB_BITS
    return [*out, value]


def _round(books: Books, width: int, parts: int, scale: int):
    """Function for ``mapInArrow``: tiles to partial sums (part, entry, place, limb, value); place -1 is the count."""
    step = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out: list[tuple[int, int, int, int, int]] = []
                kind = _kind(row, books, width)
                for p in range(parts):
                    book = np.array(books[p], dtype=kind).reshape(len(books[p]), step)
                    blocks, low, high, sums, sizes = _opened(row, p, parts, step, kind, scale)
                    short = shortlists(low, high, book)
                    alone = short.sum(axis=1) == 1
                    only = np.where(alone, short.argmax(axis=1), -1)
                    open_blocks = np.flatnonzero(~alone)
                    at, _ = nearest(blocks[open_blocks], short[open_blocks], book)
                    at[np.arange(BLOCK) >= sizes[open_blocks][:, None]] = -1  # padding
                    for k in range(len(book)):
                        mine, chosen = only == k, at == k
                        count = int(sizes[mine].sum() + chosen.sum())
                        if count:
                            wide_type = object if kind is object else np.int64
                            total = sums[mine].sum(axis=0) + blocks[open_blocks][chosen].sum(axis=0, dtype=wide_type)
                            out.append((p, k, -1, 0, count))
                            out += [(p, k, i, j, limb) for i, s in enumerate(total.tolist()) for j, limb in enumerate(_limbs(s))]
                columns = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.int64()])], names=["part", "entry", "place", "limb", "value"])

    return run


def _codes(books: Books, width: int, parts: int, scale: int, id_type: pa.DataType, label_type: pa.DataType):
    """Function for ``mapInArrow``: tiles to (id, label, codes, error)."""
    step = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                kind = _kind(row, books, width)
                codes = np.zeros((n, parts), dtype=np.uint8)
                error = np.zeros(n, dtype=object if kind is object else np.int64)
                places = np.frombuffer(row["places"], "<i4").reshape(parts, n)
                for p in range(parts):
                    book = np.array(books[p], dtype=kind).reshape(len(books[p]), step)
                    blocks, low, high, _, _ = _opened(row, p, parts, step, kind, scale)
                    at, best = nearest(blocks, shortlists(low, high, book), book)
                    codes[places[p], p] = at.reshape(-1)[:n]
                    error[places[p]] += best.reshape(-1)[:n]
                errors = [e if e < 1 << 63 else None for e in error.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], id_type), pa.array(row["labels"], label_type), pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array(errors, pa.int64())], names=["id", "label", "codes", "error"])

    return run


def compress(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Books]:
    """``id, label, codes`` (binary, one byte a part) ``, error`` of every vector kept, and the codebooks by part, entry and component."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    values = F.col(vector_column).cast("array<double>")
    fine = values.isNotNull() & F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    v = vectors.where(fine).select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), values.alias("v"))
    n, longest = v.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(-(-(longest or 0) // parts) * parts, parts)
    step = width // parts
    first = v.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    starts = [whole_numbers(np.array(list(r["v"]) + [0.0] * (width - len(r["v"]))), scale).tolist() for r in first]
    books: Books = [[s[p * step:(p + 1) * step] for s in starts] for p in range(parts)]

    from pyspark.sql.pandas.types import to_arrow_type
    id_sql, label_sql = (v.schema[c].dataType for c in ("id", "label"))
    id_type, label_type = to_arrow_type(id_sql), to_arrow_type(label_sql)
    tiles = saved(map_arrow(
        v, _tiles(width, parts, scale, id_type, label_type),
        "n int, wide boolean, bound double, rows binary, places binary, low binary, high binary, sums binary, "
        f"ids array<{id_sql.simpleString()}>, labels array<{label_sql.simpleString()}>"), "vector-tiles")
    kept = tiles.drop("ids", "labels", "places")
    for _ in range(rounds if n else 0):
        sums = map_arrow(kept, _round(books, width, parts, scale), "part int, entry int, place int, limb int, value bigint")
        totals: dict[tuple[int, int, int], int] = {}
        for r in sums.groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
            key = r["part"], r["entry"], r["place"]
            totals[key] = totals.get(key, 0) + (int(r["value"]) << (LIMB_BITS * r["limb"]))
        books = [[[totals[p, k, i] // totals[p, k, -1] for i in range(step)] if (p, k, -1) in totals else entry
                  for k, entry in enumerate(book)] for p, book in enumerate(books)]
    coded = map_arrow(tiles, _codes(books, width, parts, scale, id_type, label_type),
                      f"id {id_sql.simpleString()}, label {label_sql.simpleString()}, codes binary, error bigint")
    return saved(coded, "vector-codes"), books


def reconstruct(codes: bytes, books: Books) -> list[int]:
    """The integer components that a code stands for."""
    return [c for book, k in zip(books, codes) for c in book[k]]


def books_digest(books: Books) -> str:
    """SHA-256 of all decimal components by part, entry and component, comma-joined."""
    return hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` and ``label_error``, the error summed over equal labels (nulls together)."""
    per = coded.groupBy(F.col("label").alias("_of")).agg(
        F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)"))).alias("_sum"))
    per = saved(per.select("_of", F.col("_sum").try_cast("bigint").alias("label_error")), "vector-labels")
    per = broadcast_if_small(per, per.count(), LABELS_BROADCAST)
    return coded.join(per, F.col("label").eqNullSafe(F.col("_of"))).drop("_of")


def vector_codes(vectors: DataFrame) -> DataFrame:
    """Per vector kept: ``vec_id, code, error, label_error, codebooks_sha256``."""
    coded, books = compress(vectors)
    return with_label_errors(coded).select(
        F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
