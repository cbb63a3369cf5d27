"""Language identification by segmentation-marginalised unigrams.

Pieces are the lower-case entries of a public vocabulary, up to ``LONGEST`` bytes,
and every single byte.  Each language has a probability for each piece.  The
probability of a word is the sum over all its segmentations into pieces, found by
the forward algorithm; a text's score is the product over its words (runs of
letters, lower case, each with a word mark in front).  Expectation-maximisation
fits the probabilities to the words of a bounded sample of labelled documents:
about ``SAMPLE`` of each language, chosen by a hash of the id, whole texts.

The prediction is the language of the largest score (the first in order of name
on a tie), ``score`` its share among the languages; ``und`` with score 0 for a
null text or one without a letter.  Rows are predicted one by one: repeated rows,
null ids and extra columns are allowed.  A run of more than ``LONGEST_WORD``
letters is cut there into several words, so time and memory stay in proportion to
the text, however long it is.  Without labelled rows every text is
``und``.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, map_arrow, saved, slices

LONGEST = 8
SAMPLE = 2_000
ROUNDS = 4
SMOOTHING = 0.02
#: The model is broadcast; beyond this many probabilities the fit is refused.
MOST_PARAMETERS = 50_000_000
CACHE_UNITS = 400_000
UNKNOWN = "und"
#: A longer run of letters (a script without blanks, or junk) is cut into words of this many letters.
LONGEST_WORD = 64
LETTERS = re.compile(rf"[^\W\d_]{{1,{LONGEST_WORD}}}")
MARK = b" "


def vocabulary(path: str) -> np.ndarray:
    """Sorted keys of the pieces: their bytes as a little-endian number (no piece holds a zero byte)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(1, 256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i)
            raw = piece.replace("▁", " ").encode()
            if piece == piece.lower() and len(raw) <= LONGEST and 0 not in raw:
                pieces.add(raw)
    return np.array(sorted(int.from_bytes(p, "little") for p in pieces), dtype=np.uint64)


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


class Pieces:
    """Forward and forward-backward sums over the segmentations of words of equal length."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def at(self, words: list[bytes]) -> np.ndarray:
        """Index of the piece of each length (1 to ``LONGEST``) that ends at each place, or ``len(keys)``."""
        n, size = len(words), len(words[0])
        data = np.frombuffer(b"".join(words), np.uint8).reshape(n, size).astype(np.uint64)
        out = np.full((LONGEST, n, size), len(self.keys), dtype=np.int64)
        key = np.zeros((n, size), dtype=np.uint64)
        for k in range(min(LONGEST, size)):
            # key of the piece of k + 1 bytes that ends at a place: an earlier byte is a lower digit
            older = np.zeros_like(key)
            older[:, k:] = data[:, :size - k]
            key = older if k == 0 else (key << np.uint64(8)) | older
            found = np.searchsorted(self.keys, key[:, k:])
            found[found == len(self.keys)] = 0
            out[k][:, k:] = np.where(self.keys[found] == key[:, k:], found, len(self.keys))
        return out

    def forward(self, words: list[bytes], table: np.ndarray) -> np.ndarray:
        """Log probability of each word under each language; ``table`` has a last row of zeros."""
        n, size, langs = len(words), len(words[0]), table.shape[1]
        at = self.at(words)
        window = np.zeros((LONGEST, n, langs))  # sums of the last places, newest first
        window[0] = 1.0
        total = np.zeros((n, langs))
        for i in range(size):
            new = np.zeros((n, langs))
            for k in range(min(LONGEST, i + 1)):
                new += window[k] * table[at[k][:, i]]
            scale = np.maximum(new.max(axis=1, keepdims=True), 1e-300)
            window[1:] = window[:-1]
            window[0] = new
            window /= scale[None]
            total += np.log(scale)
        return total + np.log(np.maximum(window[0], 1e-300))

    def expect(self, words: list[bytes], counts: np.ndarray, table: np.ndarray, expected: np.ndarray) -> None:
        """Add the expected use of each piece (``counts`` times each word, for one language's ``table`` column)."""
        n, size = len(words), len(words[0])
        at = self.at(words)
        p = table[at]  # length, word, end
        ahead = np.zeros((n, size + 1))
        ahead[:, 0] = 1.0
        grown = np.zeros((n, size + 1))
        for i in range(size):
            new = np.zeros(n)
            for k in range(min(LONGEST, i + 1)):
                new += ahead[:, i - k] * np.exp(grown[:, i - k] - grown[:, i]) * p[k][:, i]
            scale = np.maximum(new, 1e-300)
            ahead[:, i + 1] = new / scale
            grown[:, i + 1] = grown[:, i] + np.log(scale)
        back = np.zeros((n, size + 1))
        back[:, size] = 1.0
        for i in range(size - 1, -1, -1):
            for k in range(min(LONGEST, size - i)):
                back[:, i] += p[k][:, i + k] * np.exp(grown[:, i] - grown[:, i + k + 1]) * back[:, i + k + 1]
        for i in range(size):
            for k in range(min(LONGEST, i + 1)):
                share = ahead[:, i - k] * np.exp(grown[:, i - k] - grown[:, i + 1]) * p[k][:, i] * back[:, i + 1]
                np.add.at(expected, at[k][:, i], share * counts)


def by_length(words: list[bytes], most: int = 2048):
    """Indices of words of equal length, in runs of bounded size."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for size, found in groups.items():
        step = max(1, min(most, (1 << 18) // size))
        for a in range(0, len(found), step):
            yield found[a:a + step]


def sample_words(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``lang, word, n`` over the sample of labelled documents that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))
    sizes = saved(known.groupBy("lang").agg(F.count("*").alias("_l_n")), "langid-sizes")
    rare = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1_000_000)) * F.col("_l_n") < sample * 1_000_000
    chosen = known.select("doc_id", "lang", "text").join(broadcast_if_small(sizes, sizes.count(), 10_000), "lang").where(rare).select("lang", "text")

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found: dict[str, Counter] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found.setdefault(lang, Counter()).update(words_of(text))
                for lang, words in found.items():
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])

    return saved(map_arrow(chosen, count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")


def fit(docs: DataFrame, vocab_path: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, piece keys and probabilities (a row for each piece, a column for each language)."""
    words = sample_words(docs, sample)
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    keys = vocabulary(vocab_path)
    if len(keys) * len(langs) > MOST_PARAMETERS:
        raise ValueError(f"{len(langs)} languages: the model would pass {MOST_PARAMETERS} parameters")
    sizes = np.array([(int(k).bit_length() + 7) // 8 for k in keys.tolist()])
    table = np.repeat((0.05 ** sizes / (0.05 ** sizes).sum())[:, None], len(langs), axis=1)
    for _ in range(rounds if langs else 0):
        model = words.sparkSession.sparkContext.broadcast((langs, keys, table))

        def step(batches, model=model):
            langs, keys, table = model.value
            pieces = Pieces(keys)
            columns = {x: i for i, x in enumerate(langs)}
            expected = np.zeros((len(langs), len(keys) + 1))
            own = np.vstack([table, np.zeros((1, len(langs)))])
            for batch in batches:
                lang = np.array([columns[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
                raw = [MARK + w.encode() for w in batch.column(1).to_pylist()]
                n = batch.column(2).to_numpy(zero_copy_only=False)
                for c in np.unique(lang).tolist():
                    some = np.flatnonzero(lang == c)
                    for run in by_length([raw[i] for i in some], 1024):
                        at = some[run]
                        pieces.expect([raw[i] for i in at], n[at], own[:, c], expected[c])
            lang, piece = np.nonzero(expected[:, :-1])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(expected[lang, piece])], names=["lang", "piece", "n"])

        used = map_arrow(words, step, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()  # pieces x languages at most
        table = np.full(table.shape, SMOOTHING)
        for r in used:
            table[r["piece"], r["lang"]] += r["n"]
        table /= table.sum(axis=0)
    return langs, keys, table


class Scorer:
    """Scores of units (stretches between blanks), kept per worker while the cache lasts."""

    def __init__(self, langs: list[str], keys: np.ndarray, table: np.ndarray):
        self.langs, self.pieces = langs, Pieces(keys)
        self.table = np.vstack([table, np.zeros((1, table.shape[1]))])
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(langs) + 1))

    def unit_rows(self, units: list[str]) -> np.ndarray:
        """A row for each distinct unit: log probability by language, and the number of words."""
        if len(self.place) > CACHE_UNITS:
            self.place, self.rows = {}, self.rows[:0]
        fresh = [u for u in units if u not in self.place]
        found = [LETTERS.findall(u) for u in fresh]
        words = sorted({w for ws in found for w in ws})
        raw = [MARK + w.encode() for w in words]
        score = np.zeros((len(words), len(self.langs) + 1))
        score[:, -1] = 1
        for run in by_length(raw):
            score[run, :-1] = self.pieces.forward([raw[i] for i in run], self.table)
        at = {w: i for i, w in enumerate(words)}
        new = np.zeros((len(fresh), len(self.langs) + 1))
        single = [(i, at[ws[0]]) for i, ws in enumerate(found) if len(ws) == 1]
        if single:
            i, j = np.array(single).T
            new[i] = score[j]
        for i, ws in enumerate(found):
            if len(ws) > 1:
                new[i] = score[[at[w] for w in ws]].sum(axis=0)
        start = len(self.rows)
        self.place.update((u, start + i) for i, u in enumerate(fresh))
        self.rows = np.vstack([self.rows, new])
        return self.rows[[self.place[u] for u in units]]

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Predicted language and score of each text."""
        if not texts or not self.langs:  # nothing to learn from
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        lists = pc.split_pattern(pc.utf8_lower(pa.array([t or "" for t in texts], pa.large_string())), " ")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        coded = lists.flatten().dictionary_encode()
        rows = self.unit_rows(coded.dictionary.to_pylist())
        total = np.add.reduceat(rows[coded.indices.to_numpy(zero_copy_only=False)], np.concatenate([[0], ends[:-1]]), axis=0)
        best = total[:, :-1].argmax(axis=1)
        share = 1.0 / np.exp(total[:, :-1] - total[np.arange(len(texts)), best][:, None]).sum(axis=1)
        some = total[:, -1] > 0
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())], np.where(some, share, 0.0)


_scorers: dict[str, Scorer] = {}


def identify(docs: DataFrame, vocab_path: str, sample: int = SAMPLE) -> DataFrame:
    """Per document ``doc_id, held_out, lang_pred, score``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, vocab_path, sample))
    d = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")

    def run(batches, key=uuid.uuid4().hex):
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(*model.value)
        own = _scorers[key]
        for batch in batches:
            for part in slices(batch, "text"):
                pred, share = own.score(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(share)], names=["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
