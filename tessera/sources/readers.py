"""S-2..S-6: the five labelled sources read from a path with a fixed schema.

The first two are needed: a load failure is raised.  The other three are
tolerated: a source that cannot be loaded gives no rows and a warning.  Loading
is checked when the reader is called, by reading one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from .adapters import select_split

SCHEMAS = {
    "roles": "conv_id string, utterance_idx long, speaker_idx string, context string, utterance string, split string",
    "dialogues": "row_id long, utterances array<string>, emotions array<long>, split string",
    "int_labels": "label long, text string, row_idx long, split string",
    "string_labels": "emotion string, text string, row_idx long, split string",
    "activations": ", ".join([
        "transcription string, file string, major_emotion string, split string",
        *(f"{c} double" for c, _ in C.ACTIVATIONS), *(f"{c} double" for c, _ in C.DIMENSIONS)]),
}
NEEDED = ("roles", "dialogues")


def read_source(spark: SparkSession, kind: str, path: str, fmt: str = "json", split: str | None = None) -> DataFrame:
    """One source; ``split`` keeps one split where the column holds any."""
    schema = T.StructType.fromDDL(SCHEMAS[kind])
    try:
        df = spark.read.schema(schema).format(fmt).load(path)
        df.limit(1).collect()
    except Exception as exc:  # noqa: BLE001 - any load failure of a tolerated source
        if kind in NEEDED:
            raise
        print(f"Warning: source {kind} could not be loaded from {path}: {exc}")
        df = spark.createDataFrame([], schema)
    rows = select_split(df, split) if split is None else df.filter(F.col("split").isNull() | (F.col("split") == split))
    return rows.drop("split")
