"""Jaccard components against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard as jc

from .conftest import EDGE


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if len(words) < 5:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i:i + 5]) for i in range(len(words) - 4)}


def plain(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "class_id", "component_id"]
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def corpus(rng, families=25):
    """Families of copies with 0 to 30 % of their words changed, cut or swapped, and shared passages."""
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 5, 7, 12, 40, 150, 400]))]
        if rng.random() < 0.4:
            base[3:3] = passage
        for _ in range(rng.choice([1, 2, 5, 9])):
            words = list(base)
            for _ in range(int(rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.06]) * len(words)) + rng.choice([0, 0, 1])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words[:max(1, int(len(words) * rng.uniform(0.75, 1)))]
            texts.append(" ".join(w.upper() if rng.random() < 0.01 else w for w in words))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, hot, tile", [(1, 10 ** 9, 1024), (2, 4, 1024), (3, 6, 3), (4, 10 ** 9, 2)])
def test_matches_all_pairs(spark, docs_of, monkeypatch, seed, hot, tile):
    """With hot hashes, and with tiles so small that blocks have many."""
    monkeypatch.setattr(jc, "TILE", tile)
    docs = corpus(random.Random(seed)) + [(900 + i, t) for i, t in enumerate(t for _, t in EDGE)] + [(None, EDGE[5][1]), (5, EDGE[5][1])]
    df = docs_of(docs).withColumn("key", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("digest", F.lit(2)).repartition(5)
    assert got(jc.jaccard_components(df, hot_share=0.0, hot_least=hot)) == plain(docs)


def test_borderline_sizes(spark, docs_of):
    """Just at, above and below the threshold, contained sets among them; each size has its own words."""
    docs = []
    for n in (10, 25, 100, 104, 204, 404):
        words = [f"x{n}y{i}" for i in range(n)]
        docs.append((len(docs), " ".join(words)))
        for m in range(int((n - 4) * 0.8) + 2, int((n - 4) * 0.8) + 7):
            docs.append((len(docs), f"only {len(docs)} " + " ".join(words[:m])))
    for n in (12, 55, 120):  # pairs of a set and a part of it
        for m in range(int((n - 4) * 0.8) + 2, int((n - 4) * 0.8) + 7):
            words = [f"z{n}m{m}y{i}" for i in range(n)]
            docs += [(len(docs), " ".join(words)), (len(docs) + 1, " ".join(words[:m]))]
    assert got(jc.jaccard_components(docs_of(docs))) == plain(docs)


def test_empty(spark, docs_of):
    assert jc.jaccard_components(docs_of([])).collect() == []
    assert got(jc.jaccard_components(docs_of([(1, None), (2, None), (3, " ")]))) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_links_meet_in_their_prefixes():
    """Any two sets that link share enough hashes of their prefixes, whatever their sizes."""
    rng = np.random.default_rng(3)
    for _ in range(3000):
        n = int(rng.integers(1, 120))
        a = rng.choice(1 << 40, n, replace=False).astype(np.uint64)
        keep = rng.permutation(a)[:max(1, int(n * rng.uniform(0.75, 1)))]
        b = np.concatenate([keep, rng.choice(1 << 40, int(n * rng.uniform(0, 0.3)), replace=False).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if jc.linked(a, b):
            shared = len(np.intersect1d(a[:jc.prefix_size(len(a))], b[:jc.prefix_size(len(b))]))
            assert shared >= max(jc.shared_size(len(a)), jc.shared_size(len(b)))


def test_tree_finds_all_components():
    """The dual traversal against all pairs, in one tree and between two."""
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(30):
        base = rng.choice(1 << 50, int(rng.integers(1, 200)), replace=False).astype(np.uint64)
        for _ in range(int(rng.integers(1, 8))):
            sets.append(np.unique(np.concatenate([rng.permutation(base)[:max(1, int(len(base) * rng.uniform(0.8, 1)))], rng.choice(1 << 50, len(base) // 12).astype(np.uint64)])))
    bits = jc.tree_bits([len(s) for s in sets])

    def joined(n, links):
        labels = np.arange(n)
        for a, b in links:
            labels[labels == labels[b]] = labels[a]
        return [set(np.flatnonzero(labels == x).tolist()) for x in np.unique(labels)]

    tree = jc.Tree(sets, np.arange(len(sets)), bits)
    found = jc.dual_links(tree, tree)
    every = [(i, j) for i in range(len(sets)) for j in range(i) if jc.linked(sets[i], sets[j])]
    assert sorted(map(sorted, joined(len(sets), found))) == sorted(map(sorted, joined(len(sets), every)))
    cut = 41
    one, two = jc.Tree(sets[:cut], np.arange(cut), bits), jc.Tree(sets[cut:], np.arange(cut, len(sets)), bits)
    own = jc.dual_links(one, one) + [(a + cut, b + cut) for a, b in jc.dual_links(two, two)]
    assert sorted(map(sorted, joined(len(sets), own + jc.dual_links(one, two)))) == sorted(map(sorted, joined(len(sets), every)))
