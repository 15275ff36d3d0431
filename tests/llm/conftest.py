import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LONG = " ".join(WORDS[(i * i + i // 7) % 24] + str(i % 97) for i in range(30_000))
NEAR = " ".join(f"word{i}" for i in range(200))

#: Nulls, empty and very long texts, ties, repeated rows, copies, odd characters.
ODD = [
    (0, None, None, None, None), (1, "", "en", "a", 0), (2, "   \n\t ", "en", "a", 6), (3, "one two", "de", "b", 7), (4, "one two", "de", None, 7),
    (5, LONG, "fr", "a", len(LONG)), (6, NEAR, "en", "a", len(NEAR)), (7, NEAR + " more", "en", "c", len(NEAR) + 5), (8, NEAR, "en", "c", len(NEAR)),
    (9, "x" * 5000 + "@", "en", "a", 5001), (10, "naïve é 日本語 \u00a0 \x1c ok ▁ x  y ", None, "d", 10), (10, "naïve é 日本語 \u00a0 \x1c ok ▁ x  y ", None, "d", 10),
    (11, "Write me@x.org, or +1 (509) 555-6973 from 10.0.0.255 or 300.1.1.1; 4111 1111 1111 1111 é a.b@c_d@e.fg 1.2.3.4.5.6.7.8 é", "en", "a", 99),
    (12, "a b c d e " * 40, "en", "a", 400), (13, "line one is here\nline one is here\n\nline one is here\n# * $ % & | < >", "en", "b", 70),
]


@pytest.fixture(scope="module")
def odd(spark):
    """The odd rows in several partitions, with columns whose names clash with those of results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, DOCS).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("size", "n_words", "_items", "h", "id", "key", "score", "set", "base", "target")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)
