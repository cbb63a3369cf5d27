"""The pipeline's stages take effect and keep clean documents."""

import __spark_entry__ as E
import corpus_pipeline
from tessera.llm import queries


def test_registered():
    names = E.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(queries.SQL) <= set(queries.REGISTRY)


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, d = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf)
        assert d.columns == docs.columns, name
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() < 2 * n and set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    clean = docs.join(labels, "doc_id").where("n_chars > 600")
    kept = corpus_pipeline.quality_stage(spark, docs, sf)
    assert clean.join(kept, "doc_id", "left_anti").count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), sf).count() == 0
