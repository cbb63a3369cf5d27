"""B-1..B-5, Q-15, Q-16."""

from tessera.functions import constants as C
from tessera.operators import shards as B
from tessera.sources import mapping as M


def _row(spark, **traits):
    vals = [float(traits.get(t, 0.0)) for t in C.TRAITS]
    schema = "utterance string, source string, origin_id string, " + ", ".join(f"{c} double" for c in C.TRAIT_COLUMNS)
    return spark.createDataFrame([("u", "s", "o", *vals)], schema)


def test_inclusive_poles(spark):
    got = sorted(r["bucket"] for r in B.bucket_rows(_row(spark, joy=0.6, humor=-0.6, wisdom=0.59)).collect())
    assert got == ["humor_minus", "joy_plus"]


def test_faithful_five_buckets(spark):
    _, scores = C.EMOTIONS["faithful"]
    got = sorted(r["bucket"] for r in B.bucket_rows(_row(spark, **scores)).collect())
    assert got == ["compassion_plus", "courage_plus", "discipline_plus", "sarcasm_minus", "wisdom_plus"]


def test_prompts(spark):
    assert B.prompt_rows(_row(spark, neuroticism=-0.3, discipline=0.3)).first()["prompt"] == "Respond naturally:"
    assert B.prompt_rows(_row(spark, joy=1, neuroticism=-0.8)).first()["prompt"] == \
        "Respond in a way that is joyful, calm:"


def test_unknown_bucket_rejected(spark):
    import pytest
    with pytest.raises(ValueError):
        B.fill_needs(spark, _row(spark), buckets=["joy_plus", "nope_plus"])


def test_bucket_dim_has_20_poles(spark):
    assert M.bucket_dim(spark).count() == 20


def test_buckets_match_predicate(spark):
    import random
    rng = random.Random(5)
    grid = [-1.0, -0.7, -0.6, -0.5, 0.0, 0.5, 0.59, 0.6, 1.0]
    rows = [(f"u{i}", "s", f"o{i}", *[rng.choice(grid) for _ in C.TRAITS]) for i in range(200)]
    schema = "utterance string, source string, origin_id string, " + ", ".join(f"{c} double" for c in C.TRAIT_COLUMNS)
    df = spark.createDataFrame(rows, schema)
    got = {(r["origin_id"], r["bucket"]) for r in B.bucket_rows(df).collect()}
    want = set()
    for r in rows:
        for t, v in zip(C.TRAITS, r[3:]):
            if v >= 0.6:
                want.add((r[2], f"{t}_plus"))
            elif v <= -0.6:
                want.add((r[2], f"{t}_minus"))
    assert got == want
