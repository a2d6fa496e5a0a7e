import pytest

from pyspark.sql import functions as F

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today. It was seen again by many people there."),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today. It was seen again by many people there."),
    (3, "the quick brown fox jumps over the lazy dog near the river bank today. it was seen again by many people here."),
    (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one two three"),
    (9, "Write to jo.doe@mail.example.com or +1 (743) 555-3824 from 10.0.0.1, card 4111 1111 1111 1111."),
    (10, "Released under the MIT License and the GNU General Public License, version 3"),
    (11, "word " * 5000), (12, "x" * 30000), (13, "ĉu éß 𝒳 \x1c\u0085 <|endoftext|> Ünïcödé  a\n \nb"),
    (14, "you idiot you moron " * 3), (None, "a row without id stays a row"), (15, "twice here"), (15, "twice here"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for name in ("n", "token", "words", "_key", "block", "component", "length", "label", "run"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
