"""S-1: the emotion -> trait mapping as small dimension tables.

The tables have a fixed, proven size (41 emotions, 7 numeric ids, 20
buckets), so joining them with ``F.broadcast`` is always safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C


def _trait_fields():
    return [T.StructField(c, T.DoubleType(), False) for c in C.TRAIT_COLUMNS]


EMOTION_SCHEMA = T.StructType(
    [T.StructField("emotion", T.StringType(), False), T.StructField("skip", T.BooleanType(), False)]
    + _trait_fields()
)

NUMERIC_SCHEMA = T.StructType(
    [
        T.StructField("emotion_id", T.LongType(), False),
        T.StructField("emotion_name", T.StringType(), False),
        T.StructField("skip", T.BooleanType(), False),
    ]
    + _trait_fields()
)


def emotion_dim(spark: SparkSession) -> DataFrame:
    """One row per named emotion: skip flag + dense trait columns."""
    rows = [(name, skip, *C.sparse_to_dense(scores)) for name, (skip, scores) in C.EMOTIONS.items()]
    return F.broadcast(spark.createDataFrame(rows, EMOTION_SCHEMA))


def numeric_dim(spark: SparkSession) -> DataFrame:
    """One row per numeric dialogue emotion id."""
    rows = [(i, name, skip, *C.sparse_to_dense(scores)) for i, (name, skip, scores) in C.NUMERIC_EMOTIONS.items()]
    return F.broadcast(spark.createDataFrame(rows, NUMERIC_SCHEMA))


def bucket_dim(spark: SparkSession) -> DataFrame:
    """N-3: the 20 trait poles with their paraphrase style."""
    schema = T.StructType([
        T.StructField("bucket", T.StringType(), False),
        T.StructField("trait", T.StringType(), False),
        T.StructField("pole", T.StringType(), False),
        T.StructField("description", T.StringType(), False),
        T.StructField("templates", T.ArrayType(T.StringType(), False), False),
    ])
    rows = []
    for b in C.BUCKETS:
        trait, pole = b.rsplit("_", 1)
        desc, templates = C.BUCKET_STYLES[b]
        rows.append((b, trait, pole, desc, templates))
    return F.broadcast(spark.createDataFrame(rows, schema))


def listener_traits():
    """Dense listener constants as literal Columns, TRAITS order."""
    return [F.lit(v) for v in C.sparse_to_dense(C.LISTENER_TRAITS)]


def alphabetical_emotion(index_col, extra: int = 2):
    """Emotion name at ``index`` of the alphabetical list; indexes past the
    end give names that are not in the mapping (``unlisted_<i>``)."""
    names = C.ALPHABETICAL_EMOTIONS + [f"unlisted_{len(C.ALPHABETICAL_EMOTIONS) + k}" for k in range(extra)]
    return F.element_at(F.array(*[F.lit(n) for n in names]), index_col.cast("int") + 1)
