import pytest

LONG = " ".join(f"w{i % 977} the of" for i in range(20_000))
#: (doc_id, text, lang, source): nulls everywhere, empty and very long texts, copies, repeated rows.
NASTY = [
    (1, "Alpha beta gamma delta", "en", "a"),
    (1, "Alpha beta gamma delta", "en", "a"),
    (2, "alpha BETA gamma delta", "en", "a"),
    (3, None, None, None),
    (4, "", "de", "b"),
    (None, "no id at all here", "en", None),
    (5, " \t\n\x0b ", None, "b"),
    (6, LONG, "en", "c"),
    (7, LONG, "en", "c"),
    (8, "one", "fr", "b"),
    (9, "one two", "fr", "b"),
    (10, "Über größe Straße naïve café", "de", "c"),
]
COLUMNS = "doc_id long, text string, lang string, source string"
#: Names that the operators use themselves.
CLASHING = ["n", "size", "score", "rank", "shard", "slot", "fp", "key", "_text", "_rank", "_order", "_at", "_k", "copies", "taken", "node", "root", "labels", "salt"]


@pytest.fixture(scope="session")
def nasty(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(NASTY, COLUMNS)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
