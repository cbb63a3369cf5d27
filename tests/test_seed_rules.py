"""Q-11..Q-13 seed cleaning and classification (FIXTURES 3.2)."""

from pyspark.sql import functions as F

from tessera.functions import text as X

CASES = [
    ("hello", None, 8),
    ("one two three four five six seven", "too_short", 8),
    ("I think the train leaves at nine tomorrow", "good_seed", 8),
    ("He put the box on the shelf today", "too_basic", 8),
    ("He put the box on the shelf today.", "good_seed", 8),
    ("Why would they paint the kitchen green again?", "simple_question", 8),
    ("She showed the whole class an old map.", "simple_question", 8),
    ("He took a knowing glance at the red door", "good_seed", 8),
    (" ".join(["word"] * 15), "good_seed", 8),
    (" ".join(["word"] * 31), "too_long", 8),
]


def classify(spark, text, min_words=8):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(X.seed_reason(F.col("t"), min_words).alias("r")).first()["r"]


def test_seed_classifier(spark):
    for text, expected, mw in CASES:
        got = classify(spark, text, mw)
        if expected is None:
            assert got == "too_short"
        else:
            assert got == expected, (text, got)


def test_too_simple_needs_low_min_words(spark):
    assert classify(spark, "hello", 1) == "too_simple"


def test_clean_seed(spark):
    df = spark.createDataFrame([("  a  lot   of\tspace here  ",), ("::: bad",), ("?!?! ..",), (None,)],
                               "t string")
    got = [r["c"] for r in df.select(X.clean_seed(F.col("t")).alias("c")).collect()]
    assert got == ["a lot of space here", None, None, None]
