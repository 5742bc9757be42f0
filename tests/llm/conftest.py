import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def table(spark):
    def make(rows, columns="doc_id long, text string"):
        return spark.createDataFrame(rows, columns).repartition(3)

    return make


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())


#: Null, empty and blank texts, repeated rows, a long text and text outside the basic plane.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, "word " * 5000), (None, "no id here at all"), (6, "\U0001f600 é " * 40)]


@pytest.fixture(scope="session")
def odd():
    return ODD
