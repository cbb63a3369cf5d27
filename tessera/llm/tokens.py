"""Byte-level BPE of the tokenizers library, batched for Spark tasks.

``UnitEncoder`` gives exactly the library's ids for whole texts, but hands each
distinct unit (a word with the blank before it) to the library once per worker
while it stays in a bounded cache, many units in one text.  A blank between two characters that are not
white space is always a boundary of the byte-level pre-tokenizer, and merges
never cross such a boundary, so the ids of a text are those of its units in
order.  A text with any other arrangement of blanks goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_UNITS = 400_000
LONGEST_CACHED = 64
#: Units in a text that the library gets.
JOINED = 256
#: White space other than the blank and the line feed, in any of the libraries' senses.
OTHER_BLANKS = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_loaded: dict[str, "UnitEncoder"] = {}


def encoder(path: str) -> "UnitEncoder":
    """The worker's encoder for a tokenizer file."""
    if path not in _loaded:
        _loaded[path] = UnitEncoder(path)
    return _loaded[path]


def check_byte_level(path: str) -> int:
    """Raise unless the file is a byte-level BPE that the encoder handles; the number of ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not plain or spec.get("normalizer") or spec["model"]["type"] != "BPE" or any(
            t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")):
        raise ValueError(f"{path}: a byte-level BPE without normalizer or padded added tokens is needed")
    return max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1


def _byte_of_char() -> dict[str, int]:
    """Printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _strings(pieces: pa.Array) -> list[str]:
    """Values without blanks, as a list by way of one string."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
    return pc.binary_join(whole, pa.scalar(" ", pieces.type))[0].as_py().split(" ")


class UnitEncoder:
    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.cache_units = cache_units
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._bytes: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _library(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 10_000):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i:i + 10_000], add_special_tokens=False)]
            raw = np.fromiter(chain.from_iterable(lists), "<u4").tobytes()
            ends = list(accumulate(map(len, lists)))
            out += [raw[4 * a:4 * b] for a, b in zip([0, *ends], ends)]
        return out

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each with a blank before it, from texts of ``JOINED`` pieces: the blank is a boundary, so
        the tokens that end with a piece's last byte are its own.  Where none does, the library gets each piece alone."""
        sizes, out = self.token_bytes()[2], []
        for i in range(0, len(pieces), 40 * JOINED):
            part = pieces[i:i + 40 * JOINED]
            texts = [" " + " ".join(part[k:k + JOINED]) for k in range(0, len(part), JOINED)]
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable([e.ids for e in found]), "<u4")
            reached = np.cumsum(sizes[ids])
            ends = np.cumsum(pc.binary_length(pa.array(part, pa.string())).to_numpy().astype(np.int64) + 1)
            at = np.searchsorted(reached, ends)
            if len(reached) and reached[-1] == ends[-1] and (reached[at] == ends).all():
                raw, cuts = ids.tobytes(), (4 * (at + 1)).tolist()
                out += [raw[a:b] for a, b in zip([0, *cuts], cuts)]
            else:
                out += self._library([" " + x for x in part])
        return out

    def _units(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, each with a blank before it."""
        if len(self.cache) > self.cache_units:  # two generations: what is still in use comes back from the older one
            self.older, self.cache = self.cache, {}
        out = list(map(self.cache.get, pieces))
        if self.older:
            for i in [i for i, ids in enumerate(out) if ids is None]:
                out[i] = self.older.get(pieces[i])
                if out[i] is not None:
                    self.cache[pieces[i]] = out[i]
        missing = [i for i, ids in enumerate(out) if ids is None]
        solid = [i for i in missing if pieces[i][-1:] not in ("", "\n")]
        blank = [i for i in missing if pieces[i][-1:] in ("", "\n")] if len(solid) < len(missing) else []
        fresh = self._joined([pieces[i] for i in solid]) + self._library([" " + pieces[i] for i in blank])
        for i, ids in zip(solid + blank, fresh):
            out[i] = ids
            if len(pieces[i]) <= LONGEST_CACHED:
                self.cache[pieces[i]] = ids
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array (32-bit), and the number of ids of each text; null counts as empty."""
        texts = [t or "" for t in texts]
        n = len(texts)
        odd = [i for i, t in enumerate(texts) if "  " in t or " \n" in t or "\n " in t or t[-1:] == " " or OTHER_BLANKS.search(t)]
        alone = dict(zip(odd, self._library([texts[i] for i in odd])))
        plain = [t for i, t in enumerate(texts) if i not in alone] if odd else texts
        counts = np.zeros(n, dtype=np.int64)
        if plain:
            lists = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
            per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(per_text)
            coded = lists.flatten().dictionary_encode()
            pieces = _strings(coded.dictionary)
            ids = pa.array(self._units(pieces) + self._library([t.partition(" ")[0] for t in plain]), pa.large_binary())
            at = coded.indices.to_numpy(zero_copy_only=False).copy()
            at[ends - per_text] = len(pieces) + np.arange(len(plain))  # a text's first piece has no blank before it
            joined = ids.take(pa.array(at))
            offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + len(at) + 1] // 4
            flat = np.frombuffer(joined.buffers()[2], "<u4")[offsets[0]:offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint32)
            of_plain = np.diff(offsets[np.concatenate([[0], ends])])
            if not odd:
                return flat, of_plain
            counts[[i for i in range(n) if i not in alone]] = of_plain
        else:
            flat = np.zeros(0, np.uint32)
        out, a = [], 0
        for i in range(n):
            if i in alone:
                out.append(np.frombuffer(alone[i], "<u4"))
                counts[i] = len(out[-1])
            else:
                out.append(flat[a:a + counts[i]])
                a += counts[i]
        return (np.concatenate(out) if out else flat), counts

    def token_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all tokens in one array, start and length of each id's."""
        if self._bytes is None:
            of = _byte_of_char()
            added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            table = [b""] * (max(vocab.values()) + 1)
            for token, i in vocab.items():
                plain = token not in added and all(c in of for c in token)
                table[i] = bytes(of[c] for c in token) if plain else token.encode()
            sizes = np.fromiter(map(len, table), np.int64, len(table))
            self._bytes = np.frombuffer(b"".join(table), np.uint8), np.cumsum(sizes) - sizes, sizes
        return self._bytes

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Decoded text of each run of ids, in UTF-8; invalid bytes become U+FFFD as in the library."""
        flat, starts, sizes = self.token_bytes()
        n = sizes[ids]
        data = gather(flat, starts[ids], n).tobytes()
        total = np.concatenate([[0], np.cumsum(n)])
        ends = total[np.cumsum(counts)].tolist()
        out, a = [], 0
        for b in ends:
            raw = data[a:b]
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = raw.decode("utf-8", "replace").encode()
            out.append(raw)
            a = b
        return out


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[start:start + size]``."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(total)]
