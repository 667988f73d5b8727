import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from texts, ids from 0; or from whole rows."""

    def make(*rows):
        full = [r if isinstance(r, tuple) else (i, r, "en", "a", None if r is None else len(r)) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture
def saved(tmp_path):
    """A folder of tables."""

    def make(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
