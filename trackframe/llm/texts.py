"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _byte_letters() -> dict[int, int]:
    """The character byte-level vocabularies write for each byte: printable ones stand for themselves, the others
    follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters(text: str) -> str:
    """The text as byte-level vocabularies write it."""
    return letters_of(text.encode())


def letters_of(raw: bytes) -> str:
    """Bytes as byte-level vocabularies write them."""
    return raw.decode("latin-1").translate(BYTE_LETTERS)


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Only A-Z become lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions_of(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def batches_of(values, size: int):
    """Lists of at most `size` items."""
    out = []
    for v in values:
        out.append(v)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out
