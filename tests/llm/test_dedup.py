"""SimHash components, repeated passages, components and quality against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from tessera.llm import graph, passages, quality, simhash

from .conftest import EDGE


def slow_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(values):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints():
    rng = random.Random(1)
    texts = [t for _, t in EDGE] + [" ".join(rng.choice("Aa bb cc dd ee".split()) for _ in range(n)) for n in (1, 2, 3, 4, 50)]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_components_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    values = list({rng.getrandbits(64) for _ in range(40)})
    for v in list(values):  # chains of near fingerprints
        for _ in range(rng.randrange(6)):
            for _ in range(rng.randrange(1, 4)):
                v ^= 1 << rng.randrange(64)
            values.append(v)
    values = sorted(set(values))
    want = slow_components(values)
    for block in (4096, 3):
        monkeypatch.setattr(simhash, "BLOCK", block)
        df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "_fp long")
        got = {r["_fp"] & (1 << 64) - 1: r["_root"] for r in simhash.fingerprint_components(df).collect()}
        groups, wanted = {}, {}
        for v, w in zip(values, want):
            groups.setdefault(got.get(v, ("alone", v)), set()).add(v)
            wanted.setdefault(w, set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_dense_block_leaves_a_forest():
    a = np.arange(8, dtype=np.uint64)  # all within three bits
    links = simhash.block_links(a, a, 3, True)
    assert len(links) == 7
    assert len(simhash.block_links(a, a + np.uint64(8), 3, False)) <= 15


def test_simhash_documents(docs_of):
    rows = EDGE + [(20, "the quick brown fox jumps over the lazy dog " * 30), (21, "the quick brown fox jumps over the lazy dog " * 30 + "end")]
    out = simhash.simhash_components(docs_of(rows)).collect()
    assert len(out) == len(rows)
    comp = {r["doc_id"]: r["component_id"] for r in out}
    assert comp[1] == comp[2] == comp[3] == 1 and comp[4] == comp[8] == 4 and comp[21] == 20
    kept = [r["doc_id"] for r in simhash.simhash_dedup(docs_of(rows)).collect()]
    assert len(kept) == len(set(kept)) and {1, 4, 20} <= set(kept) and not {2, 3, 8, 21} & set(kept)
    assert simhash.simhash_dedup(docs_of(rows).limit(0)).count() == 0


def test_connected_components(spark):
    rng = random.Random(4)
    for _ in range(2):
        edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
        parent = {}

        def find(x):
            parent.setdefault(x, x)
            return x if parent[x] == x else find(parent[x])
        for a, b in edges:
            if a != b:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        out = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
        assert out == {x: find(x) for x in parent}


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def test_passages_exact_and_fuzzy(docs_of):
    rng = random.Random(6)
    passage, license_ = words(rng, 70), words(rng, 55)
    fuzzy = list(passage)
    for i in (9, 31, 50, 64):
        fuzzy[i] = "changed"
    fuzzy[20:21] = []
    rows = [(1, words(rng, 80) + passage + words(rng, 90)), (2, words(rng, 100)), (3, words(rng, 30) + fuzzy + words(rng, 40)),
            (4, words(rng, 10) + [w.upper() for w in passage]), (5, words(rng, 200) + passage[:30])]
    rows += [(10 + i, words(rng, 20 + i) + license_ + words(rng, 30)) for i in range(12)]
    docs = docs_of([(i, " ".join(w)) for i, w in rows] + [(200 + i, t) for i, (_, t) in enumerate(EDGE[:3])] + [(None, " ".join(passage))])
    out = passages.repeated_passages(docs).collect()
    spans = {(r["doc_id"], r["of_doc"]): (r["start_word"], r["end_word"]) for r in out}
    assert set(spans) == {(3, 1), (4, 1)} | {(10 + i, 10) for i in range(1, 12)}
    assert spans[4, 1] == (10, 80)
    assert abs(spans[3, 1][0] - 30) <= 2 and abs(spans[3, 1][1] - 99) <= 2
    assert all(spans[10 + i, 10] == (20 + i, 75 + i) for i in range(1, 12))
    kept = {r["doc_id"]: r for r in passages.drop_repeated(docs).collect()}
    assert kept[4]["text"].split() == rows[3][1][:10] and kept[4]["n_chars"] == len(kept[4]["text"])
    assert kept[1]["text"].split() == rows[0][1] and kept[2]["text"].split() == rows[1][1] and kept[5]["text"].split() == rows[4][1]
    assert kept[None]["text"].split() == passage and passages.repeated_passages(docs.limit(0)).count() == 0


def test_chains_against_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randrange(2, 8)
        x0 = [rng.randrange(60) for _ in range(n)]
        y0 = [rng.randrange(60) for _ in range(n)]
        size = [rng.randrange(0, 6) for _ in range(n)]
        x1, y1 = [a + s for a, s in zip(x0, size)], [a + s for a, s in zip(y0, size)]
        k, cost = passages.K, passages.GAP_COST

        def best(j):
            own, top = float(x1[j] - x0[j] + k), 0.0
            for i in range(n):
                if x1[i] < x0[j] and y1[i] < y0[j]:
                    top = max(top, best(i) - cost * (x0[j] - x1[i] + y0[j] - y1[i]) - max(0, k - (x0[j] - x1[i])))
            return own + top
        chain = passages.chains(x0, x1, y0, y1)[0]
        score = 0.0
        for a, b in zip([None, *chain], chain):
            score += x1[b] - x0[b] + k
            if a is not None:
                score -= cost * (x0[b] - x1[a] + y0[b] - y1[a]) + max(0, k - (x0[b] - x1[a]))
        # the overlap of k-mers is known only for the predecessor found, so the score may miss it by that much
        assert score >= max(best(j) for j in range(n)) - k


def test_edit_path():
    rng = random.Random(9)
    for _ in range(50):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randrange(1, 9))]) for _ in range(2))
        matched, columns = passages.edit_path(a, b)
        assert max(len(a), len(b)) <= columns <= len(a) + len(b) and matched.sum() <= min(len(a), len(b))


def slow_repeat_words(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i:i + 8]), []).append(i)
    return len({i + k for p in places.values() if len(p) > 1 for i in p for k in range(8)})


def test_quality(docs_of):
    rng = random.Random(10)
    good = [" ".join(rng.choice(["the", "of", "and", "harbour", "window", "letters", "morning", "walks"]) for _ in range(120)) + "." for _ in range(60)]
    junk = ["%%% ### " * 60, "ABC | DEF | " * 40, "same words again and again here now then " * 8, "ab ab\nab ab\n" * 3]
    rows = [(100 + i, t) for i, t in enumerate(good + junk)] + EDGE
    out = quality.judge(docs_of(rows)).collect()
    texts = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        t = texts[r["doc_id"]] or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(map(len, w)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == slow_repeat_words(t)
        assert r["base_failed"] == (len(w) < 20 or 100 * r["n_repeat_words"] > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert {100 + i for i in range(60)} <= kept and not {160, 161, 162, 163} & kept
    assert {r["doc_id"] for r in quality.quality_filter(docs_of(rows)).collect()} == kept
    assert quality.quality_filter(docs_of(rows)).columns == docs_of(rows).columns
    assert quality.judge(docs_of(rows).limit(0)).count() == 0


def test_passages_whose_parts_stand_earlier(docs_of):
    """A changed passage meets its holder also if other documents hold its seeds first."""
    rng, rows, want = random.Random(17), [], set()
    for parts, every in ((2, 6), (3, 7), (2, 5)):
        for _ in range(3):
            passage, n, at = words(rng, 60), 60 // parts, len(rows)
            rows += [(at + p, words(rng, 30) + passage[p * n:(p + 1) * n] + words(rng, 30)) for p in range(parts)]
            changed = [w if (i + 1) % every else f"new{len(rows)}x{i}" for i, w in enumerate(passage)]
            rows += [(at + parts, words(rng, 40) + passage + words(rng, 40)), (at + parts + 1, words(rng, 40) + changed + words(rng, 40))]
            want.add((at + parts + 1, at + parts))
    found = {(r["doc_id"], r["of_doc"]) for r in passages.repeated_passages(docs_of([(i, " ".join(w)) for i, w in rows])).collect()}
    assert want <= found


def test_passages_at_low_similarity(docs_of):
    """Pairs whose best ungapped stretch, by brute force, has 50 words at similarity 0.8 are found."""
    rng = random.Random(12)
    rows, pairs = [], []
    for n, step in enumerate([5, 6, 7, 8, 10, 20] * 4 + [0] * 12):
        passage = words(rng, 60)
        changed = set(range(step - 1, 60, step)) if step else set(rng.sample(range(60), rng.randrange(3, 13)))
        other = ["changed" + str(rng.random()) if i in changed else w for i, w in enumerate(passage)]
        rows += [(2 * n, " ".join(words(rng, 30) + passage + words(rng, 20))), (2 * n + 1, " ".join(words(rng, 40) + other + words(rng, 10)))]
        equal = np.array([i not in changed for i in range(60)])
        assert max(equal[a:b].mean() for a in range(11) for b in range(a + 50, 61)) >= passages.SIMILARITY
        pairs.append((2 * n + 1, 2 * n))
    out = {(r["doc_id"], r["of_doc"]): r for r in passages.repeated_passages(docs_of(rows)).collect()}
    assert set(out) == set(pairs)
    assert all(r["start_word"] >= 36 and r["end_word"] <= 104 and r["similarity"] >= passages.SIMILARITY for r in out.values())


def test_passage_whose_parts_occur_earlier(docs_of):
    """Documents that hold a part each, before the first and between both holders of the whole."""
    rng = random.Random(13)
    rows, pairs = [], set()
    for n, sizes in enumerate([(30, 30)] * 5 + [(20, 20, 20)] * 5 + [(25, 25)] * 5 + [(38, 22)]):
        parts = [words(rng, s) for s in sizes]
        whole = [w for p in parts for w in p]
        for i, p in enumerate(parts):
            rows += [(20 * n + i, words(rng, 25) + p + words(rng, 30)), (20 * n + 11 + i, words(rng, 35) + p + words(rng, 30))]
        rows += [(20 * n + 10, words(rng, 40) + whole + words(rng, 20)), (20 * n + 19, words(rng, 10) + whole + words(rng, 20))]
        pairs.add((20 * n + 19, 20 * n + 10, 10, 10 + len(whole)))
    docs = docs_of([(i, " ".join(w)) for i, w in rows])
    out = passages.repeated_passages(docs).collect()
    assert {(r["doc_id"], r["of_doc"], r["start_word"], r["end_word"]) for r in out} == pairs
    kept = {r["doc_id"]: r["text"].split() for r in passages.drop_repeated(docs).collect()}
    assert all(len(kept[doc]) == 30 for doc, _, _, _ in pairs) and all(kept[i] == w for i, w in rows if i % 20 != 19)


def test_helper_names_among_the_columns(docs_of):
    """Input columns named like the helpers' own come through unharmed."""
    from pyspark.sql import functions as F

    from tessera.llm import mixing
    passage = " ".join(f"w{i}" for i in range(70))
    rows = [(i, f"{passage} tail {i} " + " ".join(f"v{i}x{j}" for j in range(40))) for i in range(4)]
    names = ["_mix_source", "_mix_row", "_mix_name", "_q_lang", "_q_text", "_q_kept", "_p_doc", "_P_spans", "_sh_id", "_sh_row", "_sh_place", "spans"]
    docs = docs_of(rows).withColumns({c: F.lit(f"mine {c}") for c in names})
    for stage in (mixing.mix, quality.quality_filter, quality.judge, passages.drop_repeated, simhash.simhash_dedup):
        out = stage(docs).collect()
        assert out and all(r[c] == f"mine {c}" for r in out for c in names), stage


def test_packed_seeds_give_first_holders():
    rng = np.random.default_rng(3)
    values, messages, held = rng.integers(0, 1 << 40, 60), [], {}
    for block in range(4):
        own = np.sort(rng.choice(values, 30, replace=False))
        doc, pos, several = rng.integers(-5, 9, 30), rng.integers(0, 1 << 31, 30), rng.random(30) < 0.1
        for h, d, p, s in zip(own.tolist(), doc.tolist(), pos.tolist(), several.tolist()):
            held.setdefault(h, []).append((d, p, s))
        raw = passages._packed(passages._planes(np.diff(own, prepend=0), passages.TAIL), passages._planes(doc), passages._planes(pos, passages.PLACE), np.packbits(several).tobytes())
        messages.append((block, own, raw))
    table = pa.table({"block": pa.array([m[0] for m in messages], pa.int64()), "range": pa.array([7] * 4, pa.int32()),
                      "n": pa.array([30] * 4, pa.int32()), "seeds": pa.array([m[2] for m in messages], pa.binary())})
    out = passages._first_holders(table)
    for (_, own, _), raw in zip(messages, out.column("firsts")):
        data = passages._unpacked(raw)
        shared = np.unpackbits(np.frombuffer(data[:4], np.uint8), count=30).astype(bool)
        n = int(shared.sum())
        firsts = list(zip(passages._from_planes(data[4:4 + 8 * n]).tolist(), passages._from_planes(data[4 + 8 * n:], passages.PLACE).tolist()))
        assert shared.tolist() == [len({d for d, _, _ in held[h]}) > 1 or any(s for _, _, s in held[h]) for h in own.tolist()]
        assert firsts == [min((d, p) for d, p, _ in held[h]) for h in own[shared].tolist()]


def test_chain_on_one_diagonal_is_aligned_like_any_other():
    rng = np.random.default_rng(5)
    for n in (40, 50, 70, 120):
        for every in (5, 6, 9, 200):
            a = rng.integers(1, 1 << 30, n + 100).astype(np.uint32)
            b = rng.integers(1, 1 << 30, n + 80).astype(np.uint32)
            b[30:30 + n] = a[50:50 + n]
            b[30 + every:30 + n:every] = 0
            same = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(a[50:50 + n] == b[30:30 + n], passages.K).all(axis=1))
            if not len(same):
                continue
            x0, x1 = 50 + int(same[0]), 50 + int(same[-1])
            got = passages.align(a, b, [x0, x1, x0 - 20, x1 - 20], 0, 0)
            equal = a[20:] == b[:len(a) - 20]
            for s, e, os, oe, share in got:
                assert (s - os, e - oe) == (20, 20) and e - s >= passages.MIN_WORDS
                assert share == equal[s - 20:e - 20].mean() >= passages.SIMILARITY
            best = max((equal[i:j].mean() for i in range(len(equal)) for j in range(i + passages.MIN_WORDS, min(len(equal), i + 130) + 1)), default=0)
            assert bool(got) == (best >= passages.SIMILARITY)


def test_packed_seeds_meet_all_earlier_holders(monkeypatch):
    """Matches of a hash range against brute force; a hash of more occurrences than allowed, in one block or in all, has none."""
    monkeypatch.setattr(passages, "HOLDERS", 6)
    monkeypatch.setattr(passages, "PAIRS", 20)
    rng, rows, seen = np.random.default_rng(5), [], []
    for block in range(4):
        place = np.sort(rng.choice(3 << passages.PART, 40, replace=False))
        start, h = place - rng.integers(0, 50, 40).clip(max=place), rng.integers(0, 25, 40)
        start, doc, marked = np.sort(start), np.sort(rng.integers(-5, 30, 40)), rng.random(40) < 0.02
        start = np.minimum(start, place)
        seen += [(int(x), block, int(p), int(s), int(d), bool(m)) for x, p, s, d, m in zip(h, place, start, doc, marked)]
        raw = passages._packed(passages._planes(h, passages.TAIL), passages._planes(np.diff(place, prepend=0), passages.PLACE),
                               *(passages._planes(np.diff(v, prepend=0)) for v in (start, doc)), np.packbits(marked).tobytes())
        rows.append((block + 70, 40, raw))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 2]), (pa.int64(), pa.int32(), pa.binary()))], names=["block", "n", "seeds"]) for i in (0, 2)]
    got = []
    for batch in passages._meetings(batches):
        for block, part, raw in zip(*(batch.column(c) for c in ("block", "part", "hits"))):
            data = passages._unpacked(raw)
            n = len(data) // (8 + 2 * passages.PLACE)
            place, target, tpos = passages._from_planes(data[:4 * n], 4).cumsum(), passages._from_planes(data[4 * n:12 * n]), passages._from_planes(data[12 * n:], 4)
            got += [(block.as_py(), part.as_py(), *x) for x in zip(place.tolist(), target.tolist(), tpos.tolist())]
    want = []
    for h in range(25):
        own = [s for s in seen if s[0] == h]
        if len(own) <= 6 and not any(s[5] for s in own):
            want += [(a[1] + 70, a[3] >> passages.PART, a[2], b[4], b[2] - b[3]) for a in own for b in own if b[4] < a[4]]
    assert want and sorted(got) == sorted(want)


def test_chains_that_two_bits_refuse_have_no_passage():
    """Chains on one diagonal: what alignment reports is never refused, and chance neighbours mostly are."""
    rng, refused, reported = np.random.default_rng(8), 0, 0
    for _ in range(400):
        a, b = rng.integers(0, 1 << 32, int(rng.integers(50, 200)), np.uint64).astype("<u4"), rng.integers(0, 1 << 32, int(rng.integers(50, 200)), np.uint64).astype("<u4")
        n = int(rng.integers(8, min(len(a), len(b)) + 1))
        x, y = int(rng.integers(0, len(a) - n + 1)), int(rng.integers(0, len(b) - n + 1))
        b[y:y + n] = np.where(rng.random(n) < rng.choice([0, 0.1, 0.2]), b[y:y + n], a[x:x + n])
        at = int(rng.integers(0, n - 7))
        b[y + at:y + at + 8] = a[x + at:x + at + 8]
        x0, y0, x1 = x + at, y + at, x + at + 8 - passages.K
        runs = [x0, x1, y0, y0 + x1 - x0]
        (lo, hi), (tlo, thi) = passages._around(runs, 0), passages._around(runs, 2)
        found = passages.align(a[lo:hi], b[tlo:thi], runs, lo, tlo)
        back, ahead = min(x0, passages.MARGIN), min(len(a) - x1 - passages.K, passages.MARGIN)
        some = passages._near(a & 3, *(np.array([v]) for v in (x0 - back, back, x1 - x0 + passages.K + ahead)), b & 3, *(np.array([v]) for v in (0, len(b), y0)))
        assert some[0] or not found
        refused, reported = refused + (not some[0]), reported + bool(found)
    assert refused > 100 and reported > 50
    codes = rng.integers(0, 4, 37)
    assert (passages._from_codes(memoryview(passages._codes(codes)), 37) == codes).all()


def test_passages_of_common_lines_only(docs_of):
    """Each seed that two documents share stands in more than ``HOLDERS`` others, which hold it first: the passage is still found."""
    rng = random.Random(17)
    lines = [words(rng, 13) for _ in range(4)]
    n = passages.HOLDERS + 40
    rows = [(1000 * k + i, words(rng, 22) + line + words(rng, 23)) for k, line in enumerate(lines) for i in range(n)]
    for doc in (9001, 9002):
        own = []
        for line in lines:  # one word of each changed, and one between them
            own += line[:6] + words(rng, 1) + line[7:] + words(rng, 1)
        rows.append((doc, words(rng, 30) + own[:-1] + words(rng, 30)))
    out = passages.repeated_passages(docs_of([(i, " ".join(w)) for i, w in rows])).collect()
    assert [(r["doc_id"], r["of_doc"], r["start_word"], r["end_word"], r["of_start"]) for r in out] == [(9002, 9001, 30, 85, 30)]
    assert abs(out[0]["similarity"] - 48 / 55) < 1e-5


def test_common_seeds_meet_in_tiles(monkeypatch):
    """The ends of every run within planted passages leave, inserted and deleted words among them, and all that leaves are matches."""
    from types import SimpleNamespace
    monkeypatch.setattr(passages, "PAIRS", 3000)
    rng = np.random.default_rng(4)
    fresh = lambda n: rng.integers(0, 1 << 32, n, np.uint64)
    line, base, texts = fresh(13), fresh(60), []
    for i in range(90):
        texts.append(np.concatenate([fresh(int(rng.integers(20, 60))), line, fresh(int(rng.integers(20, 60)))]))
    for i in range(12):
        own = base.copy()
        own[rng.choice(60, 7, replace=False)] = fresh(7)
        own = np.insert(np.delete(own, int(rng.integers(10, 50))), int(rng.integers(10, 50)), fresh(1))
        texts.append(np.concatenate([fresh(130), own, fresh(130), line, fresh(140)]))
    order = rng.permutation(len(texts))
    held, first, rows = {}, {}, []
    for doc, k in enumerate(order.tolist()):
        text = texts[k].astype("<u4")
        for p in range(len(text) - 3):
            key = text[p:p + 4].tobytes()
            held.setdefault(key, []).append((doc, p))
            first.setdefault(key, (doc, p))
    whole = [texts[k].astype("<u4") for k in order]
    for block in range(3):
        docs = np.arange(len(whole))[block::3]
        sizes = np.array([len(whole[d]) for d in docs])
        starts = sizes.cumsum() - sizes
        row = np.repeat(np.arange(len(docs)), sizes - 3)
        pos = np.concatenate([np.arange(s - 3) for s in sizes])
        keys = [whole[docs[r]][p:p + 4].tobytes() for r, p in zip(row, pos)]
        b = SimpleNamespace(of=np.arange(len(row)), at=(starts[row] + pos).astype(np.int32), doc=docs[row], starts=starts, sizes=sizes, row=row.astype(np.int32),
                            words=np.concatenate([whole[d] for d in docs]))
        target, tpos = (np.array(c) for c in zip(*(first[k] for k in keys)))
        some = np.array([i for i, k in enumerate(keys) if len(held[k]) > 1])
        tiles = np.where([len(held[k]) > 40 for k in keys], 3, 1)
        rows += [(block, r, n, raw) for r, n, raw in passages._common_seeds(b, some, target, tpos, tiles, 1)]
    got = set()
    for r in (0, 1):
        own = [(x[0], x[2], x[3]) for x in rows if x[1] == r]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own), (pa.int64(), pa.int32(), pa.binary()))], names=["block", "n", "seeds"])
        for out in passages._common_meetings([batch]):
            for block, raw in zip(out.column("block").to_pylist(), out.column("hits")):
                data = passages._unpacked(raw)
                n = len(data) // (8 + 2 * passages.PLACE)
                place, target, tpos = passages._from_planes(data[:4 * n], 4).cumsum(), passages._from_planes(data[4 * n:12 * n]), passages._from_planes(data[12 * n:], 4)
                ends = np.cumsum([len(whole[d]) for d in range(block, len(whole), 3)])
                at = np.searchsorted(ends, place, side="right")
                got |= {(block + 3 * int(i), int(p - (ends[i - 1] if i else 0)), int(t), int(q)) for i, p, t, q in zip(at, place, target, tpos)}
    matches = {(d, p, e, q) for own in held.values() for d, p in own for e, q in own if e < d}
    ends = {(d, p, e, q) for d, p, e, q in matches if (d, p - 1, e, q - 1) not in matches or (d, p + 1, e, q + 1) not in matches}
    planted = {m for m in ends if order[m[0]] >= 90 and order[m[2]] >= 90 and m[1] < 200}
    assert got <= matches and planted <= got and len(planted) > 300
    assert len(got) < len(ends) / 2  # a common line alone is no passage
