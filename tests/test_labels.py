"""Labelling edge cases (FIXTURES 3.3)."""

from pyspark.sql import functions as F

from tessera.operators import label as L
from tessera.operators import sample as S
from tessera.sources import adapters as A
from tessera.sources import mapping as M

LONG = "this sentence is certainly long enough to pass"


def test_first_row_defines_speaker_even_if_short(spark):
    roles = spark.createDataFrame(
        [("c1", 0, "u", "surprised", "hi"), ("c1", 1, "a", "surprised", LONG), ("c1", 2, "u", "surprised", LONG)],
        "conv_id string, utterance_idx long, speaker_idx string, context string, utterance string")
    rows = {r["origin_id"]: r for r in L.label_roles(roles, M.emotion_dim(spark)).collect()}
    assert rows["c1_turn_0"]["reason"] == "short"
    assert rows["c1_turn_2"]["reason"] == "skip_flag"          # speaker, skipped emotion
    assert rows["c1_turn_1"]["reason"] is None                 # listener kept
    assert rows["c1_turn_1"]["original_tag"] == "surprised_listener"
    assert rows["c1_turn_1"]["trait_sarcasm"] == -0.8


def test_dialogue_arrays(spark):
    df = spark.createDataFrame(
        [(1, ["first utterance here", "second one here", "third utterance"], [4, 1]),
         (2, ["never seen"], [])],
        "row_id long, dialog array<string>, emotions array<int>")
    out = L.label_dialogue(A.explode_dialogue(df), M.numeric_dim(spark)).collect()
    by = {r["origin_id"]: r for r in out}
    assert by["1_2"]["original_tag"] == "no_emotion"            # past the end -> id 0
    assert by["1_0"]["original_tag"] == "happiness"
    assert by["2_0"]["reason"] == "no_emotions"


def test_flatten_variants(spark):
    df = spark.createDataFrame([([("a",), ("b",)], None)], "utterances array<struct<text:string>>, dialog array<string>")
    assert A.flatten_dialogue(df).first()["dialog"] == ["a", "b"]
    df2 = spark.createDataFrame([("ctx", "utt")], "context string, utterance string")
    assert A.flatten_dialogue(df2).first()["dialog"] == ["ctx", "utt"]


def _act(spark, **kw):
    names = [n for n, _ in A.C.ACTIVATIONS]
    vals = {n: 0.0 for n in names}
    vals.update({k: v for k, v in kw.items() if k in names})
    row = (LONG, "f.wav", kw.get("major", "unknown"), *[vals[n] for n in names],
           kw.get("act", 0.0), kw.get("val", 0.0), kw.get("dom", 0.0))
    schema = "transcription string, file string, major_emotion string, " + \
        ", ".join(f"{n} double" for n in names) + ", EmoAct double, EmoVal double, EmoDom double"
    return L.label_activations(spark.createDataFrame([row], schema)).first()


def test_activation_rules(spark):
    r = _act(spark, excited=0.9)
    assert all(r[c] == 0 for c in L.C.TRAIT_COLUMNS)          # recode target unmapped
    r = _act(spark, angry=1.0, frustrated=1.0)
    assert r["trait_compassion"] == -1.0                        # -1.6 clamped
    r = _act(spark, sad=0.1)
    assert r["trait_joy"] == 0                                  # exactly 0.1 ignored
    r = _act(spark, act=1.0)
    assert r["trait_neuroticism"] == -1.0
    r = _act(spark, major="neutral")
    assert r["trait_discipline"] == 0.3                         # neutral fallback


def test_funnel_sums_to_input(spark):
    from tests.conftest import SF_SMALL
    c = L.classified(spark, SF_SMALL)
    total = c.count()
    conv = A.table(spark, SF_SMALL, "conversations").count()
    docs = A.table(spark, SF_SMALL, "documents").count()
    emb = A.table(spark, SF_SMALL, "embeddings").join(
        A.table(spark, SF_SMALL, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id").count()
    assert total == 2 * conv + 2 * docs + emb


def _tables(spark, tmp_path):
    """Texts of every kind, nulls and repeated keys."""
    texts = ["I am so happy about the new house we bought", "sad", "x" * 3000, None, "", "  ", "!!! ??? ...,,,", "ok fine",
             "this has CONV: id and more words here", "We are all very excited about the trip next week!"]
    conv = [(c, t, "user" if t % 2 else "agent", texts[(3 * i + t) % len(texts)])
            for i, c in enumerate([*range(90), 5, 5, None]) for t in range(4)]
    docs = [(d, texts[(d or 0) % len(texts)]) for d in [*range(200), 7, 7, None]]
    emb = [(d, [((d or 0) * k % 7) / 7.0 for k in range(12)] if (d or 0) % 9 else None) for d in [*range(0, 200, 2), 4, None]]
    spark.createDataFrame(conv, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(emb, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))


def test_corpus_rows_are_the_kept_ones_and_judge_texts_first(spark, tmp_path):
    """The same rows as the whole funnel's, also with nulls and repeated keys, and no rejected text is written or joined."""
    _tables(spark, tmp_path)
    got, want = L.corpus_rows(spark, str(tmp_path)), L.kept(L.classified(spark, str(tmp_path)))
    assert got.schema.simpleString() == want.schema.simpleString() and want.select("source").distinct().count() == 5
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    read = {f.rsplit("/", 2)[1].rsplit("-", 1)[0]: spark.read.parquet(f.rsplit("/", 1)[0]) for f in got.inputFiles() if "meaningful" in f}
    assert set(read) == {"meaningful-turns", "meaningful-documents"}
    assert all(r.filter("text is null or length(text) > 2000 or text = 'ok fine'").count() == 0 for r in read.values())


def test_json_array_needs_no_rejected_rows(spark, tmp_path, monkeypatch):
    """Nothing but the kept rows is built and written for a query over the corpus."""
    from tessera.plans import catalog
    _tables(spark, tmp_path)
    want = S.stratified_sample(L.kept(L.classified(spark, str(tmp_path)))).drop("utterance_length", "word_count")
    monkeypatch.setattr(catalog, "classified", None)
    got = catalog.REGISTRY["corpus_json_array"](spark, str(tmp_path)).select(want.columns)
    assert got.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_optional_source_and_split(spark):
    def broken():
        return spark.read.parquet("/nonexistent/path/for/tessera")
    empty = A.optional_source(spark, broken, "text string, label long")
    assert empty.count() == 0 and empty.columns == ["text", "label"]
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "t string, split string")
    assert [r["t"] for r in A.select_split(df, "test").collect()] == ["b"]
    assert A.select_split(df.drop("split"), "test").count() == 2
