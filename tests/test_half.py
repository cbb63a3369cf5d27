"""S-9: half precision against numpy, shapes, defaults."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions.half import rounded
from tessera.sources import files as FS


def bfloat16(values):
    """Round to nearest, ties to even, on the bits of single-precision floats."""
    with np.errstate(over="ignore"):
        bits = np.array(values, dtype=np.float64).astype(np.float32).view(np.uint32).astype(np.uint64)
    up = ((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16) << 16
    return up.astype(np.uint32).view(np.float32).astype(np.float64)


def numbers():
    rng = random.Random(1)
    out = [0.0, -0.0, 65504.0, 65519.99, 65520.0, -70000.0, 2.0 ** -24, 2.0 ** -25, 2.0 ** -25 * 1.0001, 3 * 2.0 ** -25, 2.0 ** -14, 6.1e-5,
           1 + 2.0 ** -11, 1 + 3 * 2.0 ** -11, 2048.5, 2049.0, 2051.0, 1 + 2.0 ** -8, 1 + 3 * 2.0 ** -8, 3.3895e38, 3.396e38, 3.4e38, 1e39, 1e-40, 4.6e-41, 9.2e-41, 1e-46,
           float("inf"), float("-inf"), 1 - 2.0 ** -12, 2 - 2.0 ** -11, 2 - 2.0 ** -9]
    out += [rng.choice([-1, 1]) * 2.0 ** rng.uniform(-140, 128) for _ in range(3000)] + [rng.uniform(-70000, 70000) for _ in range(500)]
    return out


@pytest.mark.parametrize("fmt", ["float16", "bfloat16"])
def test_rounding_matches_bits(spark, fmt):
    values = numbers()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["r"] for r in df.select("i", rounded(F.col("v"), fmt).alias("r")).orderBy("i").collect()]
    with np.errstate(over="ignore"):
        want = np.array(values).astype(np.float32).astype(np.float16).astype(np.float64) if fmt == "float16" else bfloat16(values)
    for v, a, b in zip(values, got, want):
        assert a == b and math.copysign(1, a) == math.copysign(1, b), (v, a, b)
    nan = df.limit(1).select(rounded(F.lit(float("nan")), fmt).alias("r")).first()["r"]
    assert math.isnan(nan)


def test_shapes_and_defaults(spark, tmp_path):
    doc = {"metadata": {"peft_type": "X", "task_type": None}, "state_dict": {
        "ok": {"data": [[1, 2], [3, 4]], "shape": [4]}, "bad": {"values": [1, 2, 3], "shape": [2, 2], "dtype": "float16"},
        "empty": {"shape": [0]}, "plain": [0.1]}}
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=1))
    got = {r["tensor_key"]: r["shape_ok"] for r in FS.read_adapter_tensors(spark, str(tmp_path)).collect()}
    assert got == {"ok": True, "bad": False, "empty": False, "plain": True}
    rows = FS.read_adapter_json(spark, str(tmp_path)).collect()
    assert sorted((r["adapter"], r["tensor_key"], r["pos"], r["value"]) for r in rows) == [
        ("one", "ok", 0, 1.0), ("one", "ok", 1, 2.0), ("one", "ok", 2, 3.0), ("one", "ok", 3, 4.0), ("one", "plain", 0, 0.1)]
    with pytest.raises(Exception, match="does not hold its values"):
        FS.read_adapter_json(spark, str(tmp_path), strict=True).collect()
    config = FS.read_adapter_configs(spark, str(tmp_path)).first()["config"]
    assert config == {**C.ADAPTER_DEFAULTS, "peft_type": "X", "task_type": None}
