import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import functions as F  # noqa: E402

from newsfacts.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_spark("newsfacts-tests", master="local[8]", cores=4)


BASE = " ".join(f"word{i}" for i in range(120))
TEXTS = [
    None, "", " \n\t ", "one", "two words", BASE, BASE, BASE.replace("word7 ", "other "), "x" * 50_000,
    "Ärger über Größe " * 3000, "a\n" * 400, BASE + " tail of its own", "naïve café\nline two\nline three\nline four",
]


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [(i, t, "s" if i % 3 else None, "k") for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, BASE, None, None), (None, None, None, None), (3, "another text of id three", "s", "")]
    schema = "doc_id long, text string, source string, size string"
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in (
        "id", "key", "h", "n", "cls", "part", "slot", "score", "spans", "segment", "start", "copy", "term")}).repartition(3)


@pytest.fixture(scope="session")
def empty(hard):
    return hard.limit(0)
