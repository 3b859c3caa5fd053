import pytest

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("n", T.StringType()), T.StructField("tokens", T.StringType()), T.StructField("label", T.LongType())])
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(seed, length=40):
    return " ".join(WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] + str((seed * 31 + i * 17) % 97) for i in range(length))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing names."""
    base = [(i, sentence(i), "en" if i % 2 else "de", f"s{i % 3}", 1, "x", None, i) for i in range(20)]
    odd = [(100, None, "en", "s0", None, None, None, None), (101, "", None, None, 0, None, None, None), (102, " \n\t ", "de", "s1", 1, None, None, None), (None, sentence(3), "en", None, 1, None, None, None),
           (103, "12345 !!! ...", "en", "s1", 1, None, None, None), (104, " ".join(sentence(j, 50) for j in range(600)), "en", "s2", 1, None, None, None), base[5], base[5],
           (106, sentence(6), "en", "s0", 1, None, None, None), (107, sentence(6).replace("7 ", "7 extra ", 1), "en", "s0", 1, None, None, None), (108, "Straße ÀÉ x́ <|endoftext|> don't 42 b", "de", "s9", 1, None, None, None)]
    return spark.createDataFrame(base + odd, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
