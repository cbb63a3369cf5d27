"""Block tensors, the random sample, the JSON array and the split layout."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.operators import sample as S
from tessera.operators import vectors as V
from tessera.sinks import writers as K
from tessera.sources import adapters as A

from .conftest import SF_SMALL


def test_blocks_of_uneven_tensors(spark):
    """Norms and blends of tensors whose lengths differ, against numpy."""
    rng = random.Random(2)
    adapters = {f"a{i}": {f"t{k}.lora_{'AB'[k % 2]}": [rng.gauss(0, 1) for _ in range(n)] for k, n in enumerate((64, 65, 130 + i, 3))} for i in range(4)}
    rows = [(a, t, v) for a, ts in adapters.items() for t, v in ts.items()]
    blocks = V.to_blocks(spark.createDataFrame(rows, "adapter string, tensor_key string, values array<double>"))
    norms = {r["adapter"]: r for r in V.weight_norms(blocks, "a0").collect()}
    for a, ts in adapters.items():
        for part in "AB":
            assert abs(norms[a][f"sumsq_{part.lower()}"] - sum(x * x for t, v in ts.items() if t.endswith(part) for x in v)) < 1e-5
        apart = [abs(x - y) for t, v in ts.items() for x, y in zip(v, adapters["a0"][t])]
        assert abs(norms[a]["mean_abs_diff_to_ref"] - np.mean(apart)) < 1e-5
    weights = spark.createDataFrame([(a, float(i)) for i, a in enumerate(adapters)], "adapter string, weight double")
    got = {(r["tensor_key"], r["pos"]): (r["value"], r["n_adapters"]) for r in V.blend(blocks, weights).collect()}
    want = {}
    for i, (a, ts) in enumerate(adapters.items()):
        for t, v in ts.items():
            for p, x in enumerate(v):
                total, n = want.get((t, p), (0.0, 0))
                want[t, p] = total + i * x, n + 1
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-5 and got[k][1] == want[k][1] for k in want)


def test_distribution_without_a_row_per_value(spark):
    rows = [([1.0, 2.0, 4.0],), ([],), ([1000.0],)]
    got = V.global_distribution(spark.createDataFrame(rows, "embedding array<float>"))
    values = np.array([1, 2, 4, 1000.0])
    assert tuple(got.first()) == (4, round(values.mean(), 6), round(values.std(), 6), 1.0, 1000.0)
    assert "explode(" not in got._jdf.queryExecution().executedPlan().toString()
    assert V.global_distribution(spark.createDataFrame([], "embedding array<float>")).first()["n_values"] == 0


def test_random_sample_is_bernoulli(spark):
    """Kept rows of each stratum lie within six deviations of its rate; strata do not mix, rows without a tag go."""
    n = 4000
    strata = {(s, t): rate for s, t, rate in C.SAMPLING_STRATA if t is not None} | {(s, "any"): rate for s, t, rate in C.SAMPLING_STRATA if t is None}
    rows = [(s, t, i) for s, t in strata for i in range(n)] + [(s, None, i) for s, t, _ in C.SAMPLING_STRATA if t is not None for i in range(50)] + [("unknown", "x", 1)]
    df = spark.createDataFrame(rows, "source string, original_tag string, i int")
    kept = {(r["source"], r["original_tag"]): r["count"] for r in S.random_sample(df, 7).groupBy("source", "original_tag").count().collect()}
    assert set(kept) == set(strata)
    for key, rate in strata.items():
        assert abs(kept[key] - n * rate) <= 6 * (n * rate * (1 - rate)) ** 0.5 + 1e-9
    again = {tuple(r) for r in S.random_sample(df, 7).collect()}
    assert again == {tuple(r) for r in S.random_sample(df, 7).collect()} != {tuple(r) for r in S.random_sample(df, 8).collect()}


def test_json_array_parts_make_one_array(spark, tmp_path):
    rows = spark.range(1000).select(F.concat(F.lit('say "x", [y] é\n'), F.col("id").cast("string")).alias("utterance"), F.col("id").alias("n")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one part
    K.write_json_array(rows, str(tmp_path / "a"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted((tmp_path / "a").glob("part-*"))
    got = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 1 and sorted(r["n"] for r in got) == list(range(1000)) and got[0]["utterance"].startswith('say "x"')
    back = K.read_json_array(spark, str(tmp_path / "a"), rows.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    K.write_json_array(rows.limit(0), str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none").glob("part-*"))) == []
    assert K.read_json_array(spark, str(tmp_path / "none"), rows.schema).count() == 0


def test_a_split_is_read_from_its_folder(spark, tmp_path):
    rows = A.table(spark, SF_SMALL, "conversations").withColumn("split", F.when(F.col("conv_id") % 3 == 0, "test").otherwise("train"))
    K.write_splits(rows, str(tmp_path / "s"))
    one = A.select_split(spark.read.parquet(str(tmp_path / "s")), "test")
    scan = [x for x in one._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x]
    assert len(scan) == 1 and "PartitionFilters: [isnotnull(split" in scan[0]
    assert one.count() == rows.filter("split = 'test'").count()
