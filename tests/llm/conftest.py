import pytest
from pyspark.sql import functions as F

#: One of each hard case: null and empty texts, repeats, null ids and sources, clashing column names.
DOCS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "a", 0),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "a", 1),
    (3, "one two", "b", 2), (4, "one  two", None, 3), (5, "", "b", 4), (6, None, "b", 5),
    (None, "one two", "c", 6), (7, "token = \"0123456789abcdef0123456789abcdef\" here", "c", 7),
    (7, "token = \"0123456789abcdef0123456789abcdef\" here", "c", 7), (8, "\n\n\t ", "", 8),
    (9, "word " * 30000, "b", 9), (10, "日本 🎉 naïve café.\nSecond line. Third one!", "a", 10),
]
SCHEMA = "doc_id long, text string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    table = spark.createDataFrame(DOCS, SCHEMA)
    for name in ("lang", "score", "n", "key", "sig", "base", "copies", "digest", "_0", "k", "a b.c"):
        table = table.withColumn(name, F.lit(name))
    return table


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
