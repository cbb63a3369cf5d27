"""Importance resampling against the definition in plain Python."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import importance as im
from tessera.llm.common import read_table

from .conftest import EDGE

SF = "/root/testdata/sf0.01"


def split(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def buckets_of(text, ngram):
    words = split(text)
    return [zlib.crc32(" ".join(words[i:i + n]).encode()) % 10000 for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, ngram=1):
    s, t = {}, {}
    for store, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in buckets_of(text, ngram):
                store[b] = store.get(b, 0) + 1
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t.get(b, 0) + 1) * (s_all + 10000) / ((s.get(b, 0) + 1) * (t_all + 10000))))
    rows, may = [], []
    for doc_id, text in docs:
        found = buckets_of(text, ngram)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None])
        if len(split(text)) >= 20:
            may.append(rows[-1])
    may.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(may[:10 * len(may) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, rows), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def texts(rng, n):
    vocabulary = [f"w{i}" for i in range(300)] + ["Straße", "naïve", "x_y", "don't", "日本"]
    return [" ".join(rng.choice(vocabulary[:rng.choice([20, 305])]) for _ in range(rng.choice([3, 19, 20, 60, 400]))) for _ in range(n)]


@pytest.mark.parametrize("ngram", [1, 2, 3])
def test_matches_definition(spark, docs_of, monkeypatch, ngram):
    rng = random.Random(ngram)
    monkeypatch.setattr(im, "PIECE", 50)  # many pieces a text
    docs = list(enumerate(texts(rng, 150))) + [(200 + i, t) for i, t in enumerate(t for _, t in EDGE)] + [(None, "one two " * 15), (7, "three four " * 40), (7, "three four " * 40)]
    target = texts(rng, 12) + [None, ""]
    df = docs_of(docs).withColumn("score", F.lit("clash")).withColumn("row", F.lit(1)).repartition(4)
    have = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert got(im.importance(df, have, ngram=ngram, head=40)) == plain(docs, target, ngram)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert im.importance(docs_of([]), none).collect() == []
    docs = [(i, "some words here " * 10) for i in range(20)]
    assert got(im.importance(docs_of(docs), none)) == plain(docs, [])


def test_resample_returns_whole_rows(spark, docs_of):
    rng = random.Random(5)
    docs = list(enumerate(texts(rng, 120)))
    df = docs_of(docs)
    target = spark.createDataFrame([(1, texts(rng, 1)[0])], "item_id long, text string")
    drawn = im.resample(df, target)
    assert drawn.columns == df.columns
    want = {r[0] for r in plain(docs, [target.first()["text"]]) if r[4]}
    assert {r["doc_id"] for r in drawn.collect()} == want and want


def test_query_matches_definition(spark):
    docs = [(r["doc_id"], r["text"]) for r in read_table(spark, SF, "documents").collect()]
    target = [r["text"] for r in read_table(spark, SF, "benchmark").collect()]
    from tessera.llm.queries import op12_importance
    assert got(op12_importance(spark, SF)) == plain(docs, target)


def test_long_text_without_separators(spark, docs_of):
    docs = [(1, "x" * 3_000_000), (2, "ab " * 700_000)]
    assert got(im.importance(docs_of(docs), spark.createDataFrame([(1, "ab")], "item_id long, text string"))) == plain(docs, ["ab"])
