import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


#: Nulls, empty and long texts, ties, repeated rows, special strings and several scripts.
ODD = [None, "", " ", "\n", "a", "Hello, world's <|endoftext|> end", "x" * 3000, "the cat sat " * 900, "Ünï ÇÖDÉ ñandú 東京 😀 Σίσυφος ΟΔΟΣ", "é \x1c \x85   İ ŉ 12345", "the cat sat " * 900, "it's we'll DON'T 'S"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, None if i % 3 else "en", "s", 5, 7) for i, t in enumerate(ODD)]
    rows += [(3, "repeated id", "en", None, 1, 1), (None, "null id", None, None, None, 2), (None, None, None, None, None, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank int")
