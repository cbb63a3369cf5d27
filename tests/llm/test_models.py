"""Mixing, languages, chat roles, search and main text."""

import random
import time
import re

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm import chat, htmlmain, langid, mixing, topk

from .conftest import EDGE

VOCAB = public_tokenizers.path("piece_bpe_32k.model")


def test_mixing(docs_of):
    rows = [(i, f"text {i} " * 20, "en", "big" if i < 400 else None if i < 420 else "small", 0) for i in range(500)]
    docs = docs_of(rows)
    weights = {"big": 1.0, "small": 1.0, None: 0.0}
    out = mixing.mix(docs, weights)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert None not in n and abs(n["big"] / 250 - 1) < 0.25 and abs(n["small"] / 250 - 1) < 0.25
    assert out.columns == [*docs.columns, "mix_copy", "mix_key"]
    once, twice = ({(r["doc_id"], r["mix_copy"]): r["mix_key"] for r in mixing.mix(d, weights).collect()} for d in (docs, docs.repartition(5)))
    assert once == twice and len(set(once.values())) == len(once)
    assert mixing.mix(docs_of(EDGE)).count() >= 0 and mixing.mix(docs.limit(0)).count() == 0


def test_poisson_inversion():
    rng = random.Random(3)
    for mean in (0.3, 2.0, 8.0):
        draws = [mixing.poisson_count(rng.random(), mean) for _ in range(20_000)]
        assert abs(np.mean(draws) / mean - 1) < 0.05 and abs(np.var(draws) / mean - 1) < 0.08
    assert mixing.poisson_count(0.0, 0.5) == 0 and mixing.poisson_count(0.99, 0.0) == 0


def slow_forward(word, keys, table):
    known = {int(k).to_bytes(8, "little").rstrip(b"\0"): i for i, k in enumerate(keys)}
    total = np.zeros((len(word) + 1, table.shape[1]))
    total[0] = 1
    for i in range(1, len(word) + 1):
        for j in range(max(0, i - langid.LONGEST), i):
            if word[j:i] in known:
                total[i] += total[j] * table[known[word[j:i]]]
    return np.log(total[-1])


def test_forward_sums_all_segmentations():
    keys = langid.vocabulary(VOCAB)
    rng = np.random.default_rng(1)
    table = rng.random((len(keys), 3)) / len(keys)
    own = langid.Pieces(keys)
    padded = np.vstack([table, np.zeros((1, 3))])
    for words in ([b" the", b" abc"], [" schön".encode(), " längs".encode()], [b" " + b"internationalisation" * 5]):
        for word, got in zip(words, own.forward(words, padded)):
            assert np.allclose(got, slow_forward(word, keys, table))
    # expected uses weigh each segmentation by its probability: lengths add up to the word
    expected = np.zeros(len(keys) + 1)
    own.expect([b" there"], np.array([2.0]), padded[:, 0], expected)
    sizes = np.array([(int(k).bit_length() + 7) // 8 for k in keys.tolist()])
    assert np.isclose((expected[:-1] * sizes).sum(), 2 * 6)


def test_languages_are_told_apart(spark, docs_of):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.identify(docs, VOCAB).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 20 and np.mean([r["lang_pred"] == r["lang"] for r in out]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    edge = langid.identify(docs_of(EDGE), VOCAB).collect()
    assert len(edge) == len(EDGE) and {r["lang_pred"] for r in edge if r["doc_id"] in (1, 2, 3)} == {"und"}
    none = docs_of(EDGE).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(none, VOCAB).collect()} == {"und"}
    assert langid.identify(docs.limit(0), VOCAB).count() == 0


def test_chat_roles_and_chunks(spark, monkeypatch):
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    held = F.pmod("conv_id", F.lit(4)) == 2
    counts = chat.fit(conv, held_out=held)
    out = chat.parse(conv, counts)
    got = {(r["conv_id"], r["first_turn"]): r["role"] for r in out.where("first_line = 0").collect()}
    rows = conv.where(held).collect()
    assert np.mean([got.get((r["conv_id"], r["turn"])) == r["role"] for r in rows]) >= 0.9
    whole = {(r["conv_id"], r["first_turn"], r["first_line"]): (r["role"], r["n_lines"]) for r in out.collect()}
    monkeypatch.setattr(chat, "CHUNK", 2)
    parts = {(r["conv_id"], r["first_turn"], r["first_line"]): r["role"] for r in chat.parse(conv, counts).collect()}
    assert all(parts[k][0] == whole[k][0][0] for k in whole if k in parts) and len(set(whole) - set(parts)) == 0


def test_chat_markers_and_edges(spark):
    assert chat.split_marker("User: hi") == ("user", "hi") and chat.split_marker("### Assistant: ok") == ("assistant", "ok")
    assert chat.split_marker("<|im_start|>system") == ("system", "") and chat.split_marker("Question of the day")[0] is None
    rows = [(1, 0, None, "User: what is it?\nAssistant: a thing.\nUser: thanks"), (2, 0, None, None), (2, 1, None, ""), (None, None, None, "x"), (None, None, None, "x")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.parse(conv).orderBy("conv_id", "first_line").collect()
    assert [r["role"] for r in out if r["conv_id"] == 1] == ["user", "assistant", "user"]
    assert [r["text"] for r in out if r["conv_id"] == 1] == ["what is it?", "a thing.", "thanks"]
    assert not [r for r in out if r["conv_id"] == 2] and chat.parse(conv.limit(0)).count() == 0


def test_chat_keeps_whole_texts(spark):
    bodies = ["Where is it?\n\nA: Paris, as I said\nAnswer: 42 of them\n    indented code\n\n\nContext: the year 1900\nyou\ncontext\nModel: y", "\nfirst line after a blank\nsecond line\n", "It is there.\nagent\n\nUser: is a word here"]
    rng = random.Random(14)
    line = lambda: " ".join(["word"] * rng.choice((1, 1, 2, 4, 6))) + rng.choice("?.:, ").strip()
    train = [(i, t, ("user", "assistant")[t % 2], "\n".join(line() for _ in range(rng.randrange(2, 10)))) for i in range(300) for t in range(4)]
    conv = spark.createDataFrame(train, "conv_id long, turn long, role string, text string")
    counts = chat.fit(conv)
    rows = [(i, t, None, b) for i, b in enumerate(bodies) for t in range(2)] + [(9, 0, None, "User: what\n\nis it?"), (9, 1, None, "### Assistant\na thing.\n")]
    out = chat.parse(spark.createDataFrame(rows, conv.schema), counts).collect()
    got = {(r["conv_id"], r["first_turn"]): r["text"] for r in out}
    assert len(out) == len(got) == len(rows)
    assert all(got[i, t] == b for i, t, _, b in rows if i < 9)
    assert (got[9, 0], got[9, 1]) == ("what\n\nis it?", "a thing.\n")
    assert all(r["rendered"] == f"<|{r['role']}|>\n{r['text']}\n<|end|>" for r in out)


def test_chat_chunks_are_bounded(spark, monkeypatch):
    """Rows without turns, or with one turn number, are cut into chunks too, and the parse is that of one chunk."""
    rows = [(None, None, ("user", "assistant")[i % 2], f"{i:04d} some words" + "?" * (i % 2)) for i in range(60)]
    rows += [(1, 7, None, f"{i:04d} some words" + "?" * (i % 2)) for i in range(60)] + [(2, i, None, "one and the same") for i in range(3)] + [(3, 0, None, "one and the same")] * 60
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    counts = chat.fit(conv)
    out = lambda: sorted((str(r["conv_id"]), r["text"].split("\n")[0], r["role"]) for r in chat.parse(conv, counts).collect())
    whole = out()
    monkeypatch.setattr(chat, "CHUNK", 8)
    numbered = chat._numbered(conv, [], "chat-test")
    sizes = [r["count"] for r in numbered.groupBy("conv_id", "_chunk").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 8
    cut = [r for r in numbered.where("conv_id = 1").orderBy("_chunk", "text").collect()]
    assert [r["text"] for r in cut] == sorted(r["text"] for r in cut)
    assert out() == whole and "t=>2" in chat.fit(conv)


def test_top_k_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)], 0) for i in range(300)]
    rows += [(50, rows[50][1], 0), (400, None, 0), (401, [None, 1.0], 0), (402, [float("nan")] * 8, 0), (403, [0.5], 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(topk, "ROW_TILE", 70)
    monkeypatch.setattr(topk, "QUERY_TILE", 3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect() if r["query_id"] != 50)
    fine = [(i, np.floor(256 * np.pad(np.array(v, dtype=float), (0, 8 - len(v))))) for i, v, _ in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, e in fine:
        if q is not None and q % 50 == 0 and q != 50:
            scored = sorted((-int(e @ f), topk.NO_ID if i is None else i) for j, (i, f) in enumerate(fine) if i != q)[:5]
            want += [(q, n + 1, None if i == topk.NO_ID else i, -s) for n, (s, i) in enumerate(scored)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def model_of(pages):
    counts = htmlmain.Counter()
    for p in [*pages, *htmlmain.LABELLED]:
        htmlmain.count_page(p, counts, htmlmain.LABELLED_WEIGHT)
    return htmlmain.Model(dict(counts))


def test_marginals_are_exact():
    """Message passing against the sum over all labellings of a small tree."""
    import itertools
    model = model_of([])
    nodes = htmlmain.ordered(htmlmain.parse("<body><div class=ad>x</div><article><p>long text here</p><p>more</p></article></body>"))
    own = [model.node(htmlmain.edge_kind(n), f) for n, f in zip(nodes, htmlmain.features(nodes))]
    place = {id(n): i for i, n in enumerate(nodes)}
    weight = np.zeros((len(nodes), 2))
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        s = np.log(model.total[labels[0]]) + sum(own[i][x] for i, x in enumerate(labels))
        s += sum(model.edge(htmlmain.edge_kind(n))[labels[place[id(n.parent)]]][labels[i]] for i, n in enumerate(nodes) if n.parent is not None)
        for i, x in enumerate(labels):
            weight[i, x] += np.exp(s)
    assert np.allclose(model.marginals(nodes), weight[:, 1] / weight.sum(axis=1))


def test_main_text():
    model = model_of([])
    line = "some sentence of the article that is long enough to stand. "
    page = f"<html><body><nav><ul><li><a href=/>home</a><li><a href=/b>b</a></ul></nav><article><h1>A &amp; B</h1><p>{line * 3}<p>x  y\n z<br>w<div class='ad'>buy</div></article><footer>&copy; f</footer>"
    assert htmlmain.main_text(page, model) == "A & B\n\n" + (line * 3).strip() + "\n\nx y z w"
    assert [htmlmain.main_text(p, model) for p in (None, "", "<p>", "</div></p>", "<!-- x", "<script>var a='<p>'")] == [""] * 6
    deep = "<div>" * 3000 + "x"
    assert isinstance(htmlmain.main_text(deep, model), str)


def test_main_text_without_end_of_head():
    model = model_of([])
    line = "some sentence of the article that is long enough to stand. "
    article = f"<article><h1>A</h1><p>{line * 3}</p><p>{line}</p></article>"
    want = "A\n\n" + (line * 3).strip() + "\n\n" + line.strip()
    head = "<!doctype html><html><head><meta charset=utf-8><title>not this</title><script>var a;</script><noframes><p>nor this</p></noframes>\n<link rel=x href=y>"
    for between in ("</head><body>", "<body>", "<body class=x>", "", "</head>", "<div>", "<body><head>"):
        assert htmlmain.main_text(f"{head}{between}{article}", model) == want, between
    tree = htmlmain.parse("<head><title>t</title> words <b>and</b> more")
    assert [c if isinstance(c, str) else c.tag for c in tree.children] == ["head", " words ", "b", " more"]


def test_main_text_has_math_and_objects():
    model = model_of([])
    line = "some sentence of the article that is long enough to stand. "
    page = f"<html><body><article><h1>A</h1><p>{line * 3}so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><p>{line}<object data=f.swf>a <b>plan</b> of it</object></p></article></body></html>"
    assert htmlmain.main_text(page, model) == f"A\n\n{line * 3}so x=2 holds.\n\n{line}a plan of it"


LINE = "The river rose slowly over the fields while the people of the village carried what they could to the old mill. "


def _around(body):
    menu = "<ul><li><a href=/>home</a></li><li><a href=/a>about</a></li><li><a href=/b>blog</a></li></ul>"
    return f"<html><head><title>x</title></head><body><nav>{menu}</nav>{body}<footer><p>small print</p></footer></body></html>"


@pytest.fixture(scope="module")
def fitted(spark):
    return htmlmain.Model(htmlmain.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")))


def test_names_that_hold_a_listed_word_stay(fitted):
    parts = f"<h1>Head</h1><p>{LINE * 3}</p><p>{LINE * 2}</p>"
    want = f"Head\n\n{(LINE * 3).strip()}\n\n{(LINE * 2).strip()}"
    for open_, close in (("<div class='entry-content share-enabled'>", "</div>"), ("<article class='post social-post'>", "</article>"),
                         ("<article class='has-header-image'>", "</article>"), ("<article id='article-navy'>", "</article>")):
        assert htmlmain.main_text(_around(open_ + parts + close), fitted) == want, open_
    page = _around(f"<article><p>{LINE * 3}</p><p class='shareable'>{LINE * 4}</p><div class=share-buttons><a href=x>share</a></div>"
                   f"<div class='cookie-notice'>{LINE}</div><section class=comments><p>{LINE}</p></section></article>")
    assert htmlmain.main_text(page, fitted) == f"{(LINE * 3).strip()}\n\n{(LINE * 4).strip()}"


def test_quotes_in_tags(fitted):
    two = f"{(LINE * 3).strip()}\n\n{(LINE * 2).strip()} it's"
    for odd in ("<a title=don't href=x></a>", "<a 'b href=x></a>", "<br title=\"a>b\">", "<img alt = 'a > b'>"):
        assert htmlmain.main_text(_around(f"<article><p>{LINE * 3}</p>{odd}<p>{LINE * 2} it's</p></article>"), fitted) == two, odd
    open_quote = f"<body><article><p>{LINE}</p><p title=\"abc>{LINE * 2}</p></article>"
    assert htmlmain.main_text(open_quote, fitted) == f"{LINE.strip()}\n\n{(LINE * 2).strip()}"
    assert htmlmain.main_text(f"<body><article><p>{LINE * 3}<p title='", fitted) == (LINE * 3).strip()


def test_broken_pages_take_linear_time():
    start = time.time()
    for unit in ('<p title="a>b ', "<a b='c>", "<a 'x \"y", "<", "<!--", "<a b=", "<div>", "<div><p>", "<ul><li>", "</p>", "</x>"):
        htmlmain.parse(unit * (1_000_000 // len(unit)))
    assert time.time() - start < 90


def test_articles_without_the_article_tag(spark, fitted):
    """The text of a page does not hang on its article and main tags."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    plain = [re.sub(r"<(/?)(article|main)\b", r"<\1div", p) for p in pages]
    same = sum(htmlmain.main_text(a, fitted) == htmlmain.main_text(b, fitted) for a, b in zip(pages, plain))
    assert same >= 0.95 * len(pages)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = htmlmain.extract(pages).collect()
    assert len(out) == pages.count() and all(r["n_chars"] == len(r["text"]) > 0 for r in out)
    rows = [(None, None, None), (1, "u", ""), (1, "u", "<p>"), (1, "u", "<p>")]
    edge = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r["text"] for r in htmlmain.extract(edge).collect()] == [""] * 4 and htmlmain.extract(edge.limit(0)).count() == 0


def test_long_runs_of_letters(spark, docs_of):
    """A run of letters without blanks takes time in proportion to its length."""
    base = [(i, ("the house and the water of the old man " if i % 2 else "das Haus und das Wasser und der alte Mann ") * 8) for i in range(60)]
    docs = docs_of([(i, t, "en" if i % 2 else "de", "s", len(t)) for i, t in base] + [(100, "x" * 2_000_000, None, "s", 0), (101, "漢字" * 400_000, None, "s", 0)])
    path = public_tokenizers.path("piece_bpe_32k.model")
    start = time.time()
    got = {r["doc_id"]: r for r in langid.identify(docs, path).collect()}
    assert time.time() - start < 120 and got[100]["lang_pred"] in ("en", "de") and got[1]["lang_pred"] == "en" and got[2]["lang_pred"] == "de"
    assert [len(w) for w in langid.words_of("a" * 150 + " bc")] == [64, 64, 22, 2]


@pytest.mark.parametrize("kind", ["smallint", "decimal(10,0)", "date"])
def test_chat_ids_of_any_type(spark, kind):
    rows = [(i // 4, i % 4, "user" if i % 2 == 0 else "assistant", f"User: question {i}?" if i % 2 == 0 else f"Assistant: answer {i}.") for i in range(24)]
    df = spark.createDataFrame(rows, "c int, turn long, role string, text string")
    key = F.date_add(F.lit("2020-01-01"), F.col("c")) if kind == "date" else F.col("c").cast(kind)
    out = chat.parse(df.select(key.alias("conv_id"), "turn", "role", "text"))
    assert out.schema["conv_id"].dataType.simpleString() == kind and out.select("conv_id").distinct().count() == 6


def test_viterbi_is_the_best_of_all_paths():
    """Viterbi against every state path of short transcripts, also with given states at its ends."""
    import itertools
    rng = np.random.default_rng(2)
    for _ in range(25):
        n, s = int(rng.integers(1, 6)), 4
        model = object.__new__(chat.Model)
        model.start, model.step = np.log(rng.random(s)), np.log(rng.random((s, s)))
        emit = np.log(rng.random((n, s)))
        model.emit = emit.__getitem__
        for before, end in ((None, None), (1, None), (None, 2), (3, 0)):
            first = model.start if before is None else model.step[before]
            score = lambda p: first[p[0]] + emit[0][p[0]] + sum(model.step[p[i - 1], p[i]] + emit[i][p[i]] for i in range(1, n))
            want = max((p for p in itertools.product(range(s), repeat=n) if end is None or p[-1] == end), key=score)
            assert abs(score(model.viterbi(list(range(n)), before, end)) - score(want)) < 1e-9


def test_top_k_of_large_components(spark):
    import math
    rng = random.Random(8)
    rows = [(i, [rng.choice([1e20, -1e9, 3e7, 0.5, 2.0]) * rng.random() for _ in range(6)]) for i in range(0, 120)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).orderBy("query_id", "rank").collect()]
    whole = {i: [int(x) * 256 if abs(x) > 2 ** 52 else math.floor(256 * x) for x in v] for i, v in rows}
    want = []
    for q in (0, 50, 100):
        scores = [(-max(-1 << 63, min((1 << 63) - 1, sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in whole.items() if i != q]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:5])]
    assert got == want
