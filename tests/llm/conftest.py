import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def docs(spark):
    """A function from texts to documents with ids from 0, and a column whose name an operator might use."""

    def make(texts, ids=None):
        rows = [(i, t, "en", f"s{(i or 0) % 3}" if i != 5 else None, len(t or "")) for i, t in zip(ids or range(len(texts)), texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        return df

    return make
