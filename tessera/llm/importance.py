"""Importance resampling of documents towards a target table, by hashed word runs.

A feature is a run of 1 to ``ngram`` consecutive words; its bucket is the CRC-32
of its UTF-8 bytes modulo ``buckets``.  A document's weight is the floored mean
gain of its features' buckets, a bucket's gain the log ratio of its smoothed
shares in the target and in all documents.  Documents are drawn without
replacement by weight plus hash-seeded Gumbel noise.

Head and tail.  A first pass finds the frequent words (and pairs, where
``ngram`` is over 1): a worker counts stretches of text of bounded vocabulary and
reports what reaches a share of ``1 / (4 * HEAD)`` in its stretch, which every
feature of that share in the whole corpus does at least once; Spark adds the reports up
and keeps the ``HEAD`` most frequent.  Their exact CRC states (for pairs: buckets) are broadcast:
at most ``HEAD`` entries of at most ``LONGEST`` bytes, whatever the size of the tables.  A word outside
takes its CRC directly, a longer run continues the CRC state of the run before
its last word.  Head and tail give the same numbers, so the head only saves
time; bucket totals are exact and cover all documents.  Buckets of a document
are written once, 2 or 4 bytes a feature, or as a histogram where that is
shorter; the totals (at most ``buckets`` rows) reach the driver and go back as gains.

Ranks come from a range partitioning by score and the sizes of its parts, so no
task holds all rows.

Defined cases.  A null or wordless text has no features, weight 0, and is never
drawn.  A null ``doc_id`` is hashed as ``null`` and ranks after all ids of its
score.  Repeated rows are rows of their own; equal scores of equal ids are in no fixed order.  An
empty table gives an empty result; an empty target counts as no features.  Texts
are read in pieces of ``PIECE`` bytes, cut at separators.  Other columns,
whatever their names, are ignored (or carried along where asked for).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, ship_package, slices, with_rank

NGRAM = 1
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SALT = "2024"
HEAD = 32_768
#: Bytes of a word or pair in the head tables at most.
LONGEST = 64
#: Distinct features that a worker counts before it reports.
COUNTED = 400_000
PIECE = 1 << 20

_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]


def _translation() -> bytes:
    """ASCII letters to lower case, separators to blanks, everything else as it is."""
    table = bytearray(range(256))
    for b in _SEPARATORS:
        table[b] = 0x20
    for b in range(0x41, 0x5B):
        table[b] = b + 0x20
    return bytes(table)


TABLE = _translation()


def word_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    plain = (text or b"").translate(TABLE)
    start = 0
    while start < len(plain):
        end = plain.find(b" ", start + PIECE) if start + PIECE < len(plain) else -1
        end = len(plain) if end < 0 else end
        words = plain[start:end].split(b" ")
        yield [w for w in words if w]
        start = end + 1


class Head(dict):
    """CRC states of frequent words; any other word is computed."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


class Vocabulary:
    """Buckets of features, from the broadcast head tables and direct CRCs."""

    def __init__(self, words: dict[bytes, int], pairs: dict[bytes, int], ngram: int, buckets: int):
        self.words, self.pairs, self.ngram, self.buckets = Head(words), pairs, ngram, buckets

    def features(self, text: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
        """(words, buckets of the runs ending in them) of each piece of a text."""
        before: list[bytes] = []
        for words in word_lists(text):
            yield len(words), self._runs(before, words)
            before = (before + words)[-(self.ngram - 1):] if self.ngram > 1 else []

    def _runs(self, before: list[bytes], words: list[bytes]) -> np.ndarray:
        """Runs of 1 to ``ngram`` words that end in ``words``; ``before`` are the words ahead of them."""
        states = list(map(self.words.__getitem__, words))
        parts = [np.array(states, dtype=np.uint32) % np.uint32(self.buckets)]
        if self.ngram > 1:
            both = before + words
            first = len(before)
            started = [*map(self.words.__getitem__, before), *states]  # state of the run of n words from each place
            for n in range(2, self.ngram + 1):
                made, out = [], []
                for i in range(len(both) - n + 1):
                    known = self.pairs.get(both[i] + b" " + both[i + 1]) if n == 2 and self.ngram == 2 else None
                    state = zlib.crc32(b" " + both[i + n - 1], started[i]) if known is None else 0
                    made.append(state)
                    if i + n - 1 >= first:
                        out.append(state % self.buckets if known is None else known)
                started = made
                parts.append(np.array(out, dtype=np.uint32))
        return np.concatenate(parts)


def _frequent(texts: DataFrame, pairs: bool, head: int) -> tuple[list[bytes], list[bytes]]:
    """The most frequent words and pairs of ``texts`` (column ``text``, binary)."""

    def reports(counts: Counter, total: int, pair: bool) -> list[tuple[bool, bytes, int]]:
        least = max(2, total // (4 * head))
        return [(pair, f, n) for f, n in counts.items() if n >= least and len(f) <= LONGEST]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = (Counter(), Counter()), [0, 0]

        def flush():
            found = [x for k in (0, 1) for x in reports(counts[k], totals[k], bool(k))]
            for k in (0, 1):
                counts[k].clear()
                totals[k] = 0
            columns = list(zip(*found)) if found else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.binary(), pa.int64()))], names=["pair", "feature", "n"])

        for whole in batches:
            for text in whole.column(0):
                last: list[bytes] = []
                for words in word_lists(text.as_py()):
                    counts[0].update(words)
                    totals[0] += len(words)
                    if pairs:
                        both = last + words
                        counts[1].update(a + b" " + b for a, b in zip(both, both[1:]))
                        totals[1] += max(len(both) - 1, 0)
                        last = both[-1:]
                    if len(counts[0]) + len(counts[1]) > COUNTED:
                        yield flush()
        yield flush()

    found = texts.mapInArrow(run, "pair boolean, feature binary, n bigint").groupBy("pair", "feature").agg(F.sum("n").alias("n"))
    top = lambda pair: [bytes(r["feature"]) for r in found.where(F.col("pair") == pair).orderBy(F.desc("n"), "feature").limit(head).collect()]
    if pairs:
        found = saved(found, "importance-head")
    return top(False), top(True) if pairs else []


def _totals(parts: DataFrame) -> dict[int, int]:
    """Sums of (bucket, n) rows; at most as many as there are buckets."""
    return {r["bucket"]: int(r["n"]) for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def _counted(batch_counts: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(batch_counts)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(batch_counts[at], pa.int64())], names=["bucket", "n"])


def _unpack(kind: int, raw: bytes, buckets: int) -> np.ndarray:
    """Counts by bucket (kind 0), or the buckets of the features (their bytes)."""
    return np.frombuffer(raw, {0: "<i8", 2: "<u2", 4: "<u4"}[kind])


def gains(target: dict[int, int], corpus: dict[int, int], buckets: int) -> list[int]:
    """Floored thousandfold log ratios of smoothed shares, by bucket."""
    s_all, t_all = sum(corpus.values()), sum(target.values())
    return [math.floor(1000 * math.log(float(target.get(b, 0) + 1) * float(s_all + buckets) / (float(corpus.get(b, 0) + 1) * float(t_all + buckets))))
            for b in range(buckets)]


def noise(name: str, salt: str = SALT) -> int:
    """Gumbel noise in thousandths, seeded by the hash of salt and name."""
    h = int(hashlib.sha256(f"{salt}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, keep: list[str], ngram: int = NGRAM, buckets: int = BUCKETS, percent: int = PERCENT,
           least_words: int = LEAST_WORDS, salt: str = SALT, head: int = HEAD) -> DataFrame:
    """``row`` (a struct of the columns ``keep``) ``, n_features, weight, score, rank`` of every document; undrawn ranks are null."""
    spark = docs.sparkSession
    ship_package(spark)
    text = F.col("text").cast("string").cast("binary").alias("text")
    texts, target_texts = docs.select(text), target.select(text)
    words, pairs = _frequent(texts, ngram > 1, head)
    tables = spark.sparkContext.broadcast((
        {w: zlib.crc32(w) for w in words}, {p: zlib.crc32(p) % buckets for p in pairs}))
    narrow = 2 if buckets <= 1 << 16 else 4

    def pack(vocabulary: Vocabulary, text: bytes | None) -> tuple[int, int, int, bytes]:
        n_words, counts, parts, n = 0, None, [], 0
        for more, found in vocabulary.features(text):
            n_words += more
            n += len(found)
            parts.append(found)
            if counts is not None or n * narrow > 8 * buckets:
                own = np.bincount(np.concatenate(parts), minlength=buckets)
                counts, parts = own if counts is None else counts + own, []
        if counts is not None:
            return n_words, n, 0, counts.astype("<i8").tobytes()
        return n_words, n, narrow, b"".join(p.astype(f"<u{narrow}").tobytes() for p in parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(*tables.value, ngram, buckets)
        for whole in batches:
            for batch in slices(whole, "text"):
                packed = [pack(vocabulary, t.as_py()) for t in batch.column(2)]
                n_words, n, kinds, raw = zip(*packed)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(kinds, pa.int32()), pa.array(raw, pa.binary())],
                    names=["row", "name", "n_words", "n_features", "kind", "packed"])

    def target_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = Vocabulary(*tables.value, ngram, buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                for _, found in vocabulary.features(t.as_py()):
                    counts += np.bincount(found, minlength=buckets)
        yield _counted(counts)

    def corpus_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for kind, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = _unpack(kind, raw.as_py(), buckets)
                counts += values if kind == 0 else np.bincount(values, minlength=buckets)
        yield _counted(counts)

    source = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("name"), text)
    row = T.StructField("row", source.schema["row"].dataType)
    schema = T.StructType([row, T.StructField("name", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()),
                           T.StructField("kind", T.IntegerType()), T.StructField("packed", T.BinaryType())])
    encoded = saved(source.mapInArrow(encode, schema), "importance")
    of_target = _totals(target_texts.mapInArrow(target_counts, "bucket bigint, n bigint"))
    of_corpus = _totals(encoded.select("kind", "packed").mapInArrow(corpus_counts, "bucket bigint, n bigint"))
    gain = np.array(gains(of_target, of_corpus, buckets), dtype=np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, n_words, n, kinds = (batch.column(i).to_pylist() for i in (1, 2, 3, 4))
            weights, scores = [], []
            for name, count, kind, raw in zip(names, n, kinds, batch.column(5)):
                values = _unpack(kind, raw.as_py(), buckets)
                total = int(values @ gain) if kind == 0 else int(gain[values].sum())
                weights.append(total // count if count else 0)
                scores.append(weights[-1] + noise(name, salt))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(weights, pa.int64()), pa.array(scores, pa.int64())],
                names=["row", "n_words", "n_features", "weight", "score"])

    schema = T.StructType([row, *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score"))])
    weighed = saved(encoded.mapInArrow(weigh, schema).withColumn("own", F.monotonically_increasing_id()), "importance-scores")
    may = F.col("n_words") >= least_words
    drawn = percent * weighed.where(may).count() // 100
    order = [F.desc("score"), F.asc_nulls_last(F.col("row.doc_id") if "doc_id" in keep else F.lit(0)), F.asc("own")]
    ranked = with_rank(weighed.where(may), order, "importance-ranks").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    columns = ["row", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(weighed.where(~may).withColumn("rank", F.lit(None).cast("bigint")).select(*columns))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, whole rows."""
    return scored(docs, target, docs.columns, **options).where(F.col("rank").isNotNull()).select("row.*")


def importance(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """Per document: ``doc_id, n_features, weight, score, rank``."""
    return scored(docs, target, ["doc_id"], **options).select(F.col("row.doc_id").alias("doc_id"), "n_features", "weight", "score", "rank")
