"""Token ids: exact against the tokenizers library, and exact round trips of the files."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import bpe, huffman, tokens
from tessera.session import scratch_path

from .conftest import EDGE

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "the", " ", "  ", " ", "\n", " \n", "'s", "'re", "'", "9", "12", ".", ",", "!!", "é", "ß", "Жи", "中文", " ",
         " ", "　", "\x1c", "\x85", "<|endoftext|>", "<|endof", "text|>", "🙂", "\t", "longlonglong", " word", " of", " and"]


def texts_of(seed):
    rng = random.Random(seed)
    base = "".join(rng.choice([" the", " of", " word", " thing,", "ab.\n"]) for _ in range(2500))
    return ["", None, " ", "a ", "\n", base, base[:4000] + "x" + base[4000:], base[100:], base * 2,
            *["".join(rng.choice(PARTS) for _ in range(rng.choice([1, 3, 8, 30, 200, 1200]))) for _ in range(300)]]


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def split(ids, counts):
    ends = np.cumsum(counts)
    return [ids[b - n:b].tolist() for b, n in zip(ends, counts)]


@pytest.mark.parametrize("cache", [50, 400_000])
def test_unit_encoder_gives_the_library_ids(cache):
    texts = texts_of(1)
    own = tokens.UnitEncoder(PATH, cache_units=cache)
    for _ in range(2):
        assert split(*own.encode(texts)) == library(texts)
    ids, counts = own.encode(texts)
    t = Tokenizer.from_file(PATH)
    assert [b.decode() for b in own.decode(ids, counts)] == [t.decode(x, skip_special_tokens=False) for x in library(texts)]


def test_units_reach_the_library_many_in_a_text():
    enc = tokens.UnitEncoder(PATH)
    library, handed = enc.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **kw):
            handed.extend(texts)
            return library.encode_batch_fast(texts, **kw)

        def __getattr__(self, name):
            return getattr(library, name)
    enc.tokenizer = Counting()
    texts = [" ".join(f"w{i}x{j}.," for j in range(500)) for i in range(10)] + [" a\n\nb c\n", "é'll <|endoftext|>y\u0301 z\n\n", "x"]
    ids, counts = enc.encode(texts)
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]
    assert len(handed) < 100  # about 5,000 distinct units


def test_decode_of_broken_bytes():
    own, t = tokens.UnitEncoder(PATH), Tokenizer.from_file(PATH)
    half = t.encode("🙂", add_special_tokens=False).ids[:1]
    assert own.decode(np.array(half), np.array([1]))[0].decode() == t.decode(half, skip_special_tokens=False)


def test_chunk_encoder_gives_the_library_ids_and_reuses():
    texts = texts_of(2)
    own = bpe.ChunkEncoder(PATH)
    for part in (texts, texts[5:], texts[7:9]):
        assert split(*own.encode([(t or "").encode() for t in part])) == library(part)
    assert own.reused > own.encoded > 0


def test_cuts_depend_on_content():
    rng = random.Random(5)
    body = "".join(rng.choice("abcdefgh ") for _ in range(30_000)).encode()
    a, _ = bpe.cut_places(np.frombuffer(body, np.uint8), np.array([len(body)]))
    moved = b"another start " + body
    b, _ = bpe.cut_places(np.frombuffer(moved, np.uint8), np.array([len(moved)]))
    shared = {bytes(body[i:i + 40]) for i in a[1:-1]} & {bytes(moved[i:i + 40]) for i in b[1:-1]}
    assert len(a) > 10 and len(shared) >= len(a) - 3


def test_bpe_documents(docs_of):
    out = {}
    for r in bpe.encode_documents(docs_of(EDGE), PATH).collect():
        out.setdefault(r["doc_id"], []).append(r)
    t = Tokenizer.from_file(PATH)
    assert sum(map(len, out.values())) == len(EDGE)
    for doc_id, text in EDGE:
        ids = t.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        for r in out[doc_id]:
            assert bytes(r["ids"]) == raw and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(raw).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(docs_of(EDGE).limit(0), PATH).count() == 0


def test_code_lengths_are_optimal_under_the_limit():
    rng = np.random.default_rng(3)

    def best(counts, limit):
        sizes = itertools.product(range(1, limit + 1), repeat=len(counts))
        return min(sum(a * b for a, b in zip(counts, s)) for s in sizes if sum(2.0 ** -x for x in s) <= 1)
    for _ in range(30):
        counts = rng.integers(1, 80, rng.integers(2, 6))
        lengths = huffman.code_lengths(counts, 3)
        assert lengths.max() <= 3 and (counts * lengths).sum() == best(counts.tolist(), 3)
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5), 2)


@pytest.mark.parametrize("symbols,limit", [(1, 16), (2, 16), (300, 9), (50_000, 16)])
def test_code_round_trip(symbols, limit):
    rng = np.random.default_rng(symbols)
    counts = np.maximum(1, (1e9 / np.arange(1, symbols + 1) ** 2.5).astype(np.int64))
    ids = np.sort(rng.choice(70_000, symbols, replace=False))
    code = huffman.Code(ids, huffman.code_lengths(counts, limit))
    sizes = np.array([0, 1, huffman.STRIDE, huffman.STRIDE + 1, huffman.BLOCK, huffman.BLOCK + 1, 20_000, 0])
    x = rng.choice(ids, sizes.sum()).astype(np.uint32)
    payloads = code.encode(x, sizes)
    y, n = code.decode(payloads)
    assert (n == sizes).all() and (x == y).all()
    one, n = code.decode([payloads[5]])  # a document alone
    assert len(one) == huffman.BLOCK + 1


def test_token_files(spark, docs_of):
    rows = [r for r in EDGE if r[0] is not None] + [(100 + i, f"text number {i} " * (i % 7)) for i in range(300)]
    folder = scratch_path(spark, "test-files")
    out = huffman.token_files(docs_of(rows), PATH, folder, with_ids=True).collect()
    got = sorted(out, key=lambda r: r["start"])
    t, start = Tokenizer.from_file(PATH), 0
    assert [r["doc_id"] for r in got] == sorted(r[0] for r in rows)
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in rows}
    for r in got:
        raw = np.array(want[r["doc_id"]], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], bytes(r["ids"]), r["ids_crc32"]) == (start, len(raw) // 4, raw, zlib.crc32(raw))
        start += r["n_tokens"]
    again = huffman.read_ids(spark, folder).count()
    assert again == len(rows)
    assert huffman.token_files(docs_of(rows).limit(0), PATH).count() == 0
    assert huffman.token_files(docs_of(EDGE), PATH).count() == len(EDGE)
