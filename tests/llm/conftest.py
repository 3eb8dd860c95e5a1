import pytest
from pyspark.sql import types as T

LONG = "lorem ipsum dolor " * 40_000

ROWS = [
    (5, "The quick brown fox jumps over the lazy dog, call +1 (755) 555-9729 or mail a.b@c.example.org.", "en", "s", 1),
    (3, None, None, None, None),
    (4, "", "en", "s", 0),
    (9, "  \n\t ", "en", None, 4),
    (7, "Éèon une en auxou's 12 x́ ΣΑΣ don't 🙂 42.144.35.254 4041894974608795", "fr", "s", 3),
    (7, "Éèon une en auxou's 12 x́ ΣΑΣ don't 🙂 42.144.35.254 4041894974608795", "fr", "s", 3),
    (11, "same text here for ties", "en", "s", 2),
    (12, "same text here for ties", "en", "s", 2),
    (13, "word", "en", "s", 4),
    (2, LONG, "en", "s", len(LONG)),
]


@pytest.fixture(scope="session")
def schema():
    """``documents`` with further columns whose names the operators use themselves."""
    fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
    extra = [(n, T.StringType()) for n in ("ids", "h", "node", "label", "_id", "toxicity", "passages", "log_weight", "quality_score", "bucket", "place")]
    return T.StructType([T.StructField(n, t) for n, t in fields + extra])


@pytest.fixture(scope="session")
def docs(spark, schema):
    return spark.createDataFrame([(*r, *["x"] * 11) for r in ROWS], schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, schema):
    return spark.createDataFrame([], schema)


@pytest.fixture(scope="session")
def null_ids(spark, schema):
    return spark.createDataFrame([(None, t, None, None, None, *["x"] * 11) for t in ("one text", "one text", "another", None)], schema)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 5 and 1, int(i % 3 == 0)) for i in range(20)] + [(None, 1, 1), (6, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
