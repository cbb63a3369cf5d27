import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from tessera.session import local_session  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    return local_session(cores="*", shuffle_partitions=8, app="tessera-tests")


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        """Documents from ``(doc_id, text)`` or whole rows, with an extra column of a clashing name."""
        full = [r if len(r) == 5 else (r[0], r[1], "en", f"s{(r[0] or 0) % 3}", len(r[1] or "")) for r in rows]
        from pyspark.sql import functions as F
        return spark.createDataFrame(full, DOCS).withColumn("n_words", F.lit("extra"))
    return make


#: Nulls, empty and blank texts, repeated rows, ties and a long text.
EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (4, "one two"), (5, "a " * 3000), (6, "ä" * 5000), (None, "no id here"),
        (7, "x<|endoftext|>y  z\n"), (8, "One Two"), (9, "word " * 2 + "　 \x1c tail ")]
