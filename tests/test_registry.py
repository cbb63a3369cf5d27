"""R-1..R-6: fingerprints and planning."""

from pyspark.sql import functions as F

from tessera.operators import registry as RG


def _rows(spark, n=200):
    return spark.createDataFrame([(f"b{i % 3}", f"p{i}", f"c{i}") for i in range(n)],
                                 "bucket string, prompt string, completion string")


def test_fingerprint_order_and_partition_invariant(spark):
    rows = _rows(spark)
    a = {r["bucket"]: r["hash"] for r in RG.shard_fingerprints(rows).collect()}
    b = {r["bucket"]: r["hash"] for r in RG.shard_fingerprints(rows.repartition(7).orderBy(F.rand(3))).collect()}
    assert a == b
    changed = rows.withColumn("completion", F.when(F.col("prompt") == "p0", "x").otherwise(F.col("completion")))
    c = {r["bucket"]: r["hash"] for r in RG.shard_fingerprints(changed).collect()}
    assert c["b0"] != a["b0"] and c["b1"] == a["b1"]


def test_run_plan_actions(spark):
    fps = RG.shard_fingerprints(_rows(spark))
    reg = spark.createDataFrame(
        [(r["hash"], f"ft-{i}", "f", r["bucket"], 1.0, s) for i, (r, s) in
         enumerate(zip(sorted(fps.collect(), key=lambda r: r["bucket"]), ["completed", "failed"]))],
        "hash string, job_id string, file_name string, trait string, created_at double, status string")
    plan = {r["bucket"]: (r["action"], r["job_id"]) for r in RG.run_plan(fps, reg).collect()}
    assert plan == {"b0": ("skip_completed", "ft-0"), "b1": ("retry_failed", None), "b2": ("launch", None)}
    forced = {r["bucket"]: r["action"] for r in RG.run_plan(fps, reg, force_retrain=True).collect()}
    assert set(forced.values()) == {"launch"}
    up = RG.registry_upsert(reg, RG.run_plan(fps, reg), 2.0)
    assert up.count() == 3 and up.filter(F.col("created_at") == 2.0).count() == 2


def test_all_with_names_rejected(spark):
    import pytest
    with pytest.raises(ValueError):
        RG.requested_buckets(spark, ["joy_plus"], all_poles=True)
