"""X-1..X-15."""

from pyspark.sql import functions as F

from tessera.operators import vectors as V


def test_name_vectors(spark):
    names = spark.createDataFrame([("joy_plus",), ("sarcasm_plus",), ("sarcasm_minus",), ("wisdom_minus",)], "name string")
    strict = {r["name"]: r for r in V.vector_table(names).collect()}
    assert strict["joy_plus"]["zero_vector"]                      # planner list has no 'joy'
    assert strict["wisdom_minus"]["v3"] == -1.0
    lenient = {r["name"]: r for r in V.lenient_table(names).collect()}
    assert lenient["wisdom_minus"]["v0"] == -1.0 and not lenient["wisdom_minus"]["fallback"]
    assert lenient["sarcasm_plus"]["fallback"]
    assert sum(lenient["sarcasm_plus"][f"v{i}"] for i in range(10)) == 0.3
    audit = {r["name"]: r for r in V.vector_audit(V.lenient_table(names)).collect()}
    assert audit["wisdom_minus"]["n_sharing"] == 1


def test_cosine_guard(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r["c"] for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] is None and abs(got[1] - 1.0) < 1e-12


def test_fit(spark):
    df = spark.createDataFrame([([1.0] * 3,), ([1.0] * 1030,)], "v array<float>")
    got = [r["n"] for r in df.select(F.size(V.fit(F.col("v"))).alias("n")).collect()]
    assert got == [1024, 1024]


def test_adapter_roundtrip(spark, tmp_path):
    from tests.conftest import SF_SMALL
    from tessera.plans import catalog
    ingested = catalog.REGISTRY["adapter_json_ingest"](spark, SF_SMALL)
    direct = V.adapter_tensors(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet"))
    a = ingested.select("adapter", "tensor_key", "pos", F.col("value").cast("float").alias("v"))
    b = direct.select("adapter", "tensor_key", "pos", F.col("value").cast("float").alias("v"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
