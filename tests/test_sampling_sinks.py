"""M-1 determinism, K-* round trips, S-10."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import label as L
from tessera.operators import sample as S
from tessera.sinks import writers as K
from tessera.sources import files as FS

from .conftest import SF_SMALL


def test_sample_idempotent_and_partition_invariant(spark):
    raw = L.corpus_raw(spark, SF_SMALL)
    a = S.stratified_sample(raw).select("source", "origin_id")
    b = S.stratified_sample(raw.repartition(5)).select("source", "origin_id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    once = S.stratified_sample(raw)
    twice = S.stratified_sample(once)
    assert once.exceptAll(twice).count() == 0 and twice.count() == once.count()   # idempotent


def test_exports_roundtrip(spark, tmp_path):
    corpus = L.corpus_raw(spark, SF_SMALL)
    n = corpus.count()
    K.export_corpus(corpus, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == n
    K.export_corpus(corpus, str(tmp_path / "c"), "csv")
    assert K.read_csv_corpus(spark, str(tmp_path / "c"), corpus.schema).count() == n
    K.export_corpus(corpus, str(tmp_path / "j"), "jsonl")
    back = K.flat(FS.read_corpus_jsonl(spark, str(tmp_path / "j")))
    assert back.count() == n
    with pytest.raises(ValueError):
        K.export_corpus(corpus, str(tmp_path / "x"), "xml")


def test_artifact_audit(spark, tmp_path):
    good = tmp_path / "good.safetensors"
    good.write_bytes((4).to_bytes(8, "little") + b"{}  ")
    bad = tmp_path / "bad.safetensors"
    bad.write_bytes((10 ** 6).to_bytes(8, "little") + b"{}")
    got = {r["file_name"]: r["corrupt"] for r in FS.artifact_audit(spark, str(tmp_path / "*.safetensors")).collect()}
    assert got == {"good.safetensors": False, "bad.safetensors": True}


def test_seed_loader_window(spark, tmp_path):
    from tessera.operators import seeds as SD
    lines = [" ".join(["w"] * n) for n in (8, 9, 29, 30)] + ['{"utterance": "' + " ".join(["j"] * 10) + '"}']
    (tmp_path / "s.txt").write_text("\n".join(lines) + "\n")
    got = sorted(len(r["seed"].split()) for r in SD.read_seed_lines(spark, str(tmp_path / "s.txt")).collect())
    assert got == [9, 10, 29]
    assert SD.read_seed_lines(spark, str(tmp_path / "s.txt"), max_per_file=2).count() == 1


def test_seed_file_scan_returns_every_seed(spark, monkeypatch):
    """More seeds in one write partition than a file's lines that are read."""
    from tessera.plans import catalog

    seeds = spark.range(12_000).coalesce(1).selectExpr(
        "id AS conv_id", "id AS turn", "concat('seed number ', id, ' has a few more words in its line') AS utterance", "'joy' AS emotion")
    monkeypatch.setattr(catalog, "_seed_classified", lambda *a: None)
    monkeypatch.setattr(catalog.SD, "seed_rows", lambda *a: seeds)
    out = catalog.seed_file_scan(spark, None)
    assert out.count() == 24_000 and out.distinct().count() == 12_000
