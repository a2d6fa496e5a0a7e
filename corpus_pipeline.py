"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, documents that hold
benchmark passages go, personal data is masked, and what is left is packed into sequences.

Thresholds: toxic when P(grade > 0) is at least 1/2; near duplicates share at least 0.8 of their runs of 5 words;
benchmark passages are similar to an item by 0.8 or more; sequences have 2048 tokens.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from trackframe.llm import decontamination, ngram_join, packing, pii, toxicity
from trackframe.llm.texts import table
from trackframe.session import checkpoint_dir, cut_lineage


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def renamed(docs: DataFrame) -> DataFrame:
    """docs with names for all columns but doc_id and text that no operator uses."""
    return docs.toDF(*[n if n in ("doc_id", "text") else f"c{i}" for i, n in enumerate(docs.columns)])


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose predicted severity is not toxic. The model is fitted on the given rows that labels covers.

    Null and empty texts have no telling words and are judged like any text without them. Texts are read whole,
    repeated rows stay, columns of any name are kept, an empty table stays empty.
    """
    severity = fresh(docs, "_severity")
    model = toxicity.fitted_model(docs, table(spark, sf_dir, "labels"), "toxic", refine=2)
    return toxicity.with_severity(docs, model, column=severity).filter(~F.col(f"{severity}.toxic")).drop(severity)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of every group of near duplicates; of rows that share it, or have none, the
    first in the table.

    Rows are joined by their number in the table, not by id: different texts of one id, and of rows without id, are
    different documents, and a repeated row is a copy. Rows without words are near to nothing and stay. Texts are
    read whole, columns of any name are kept, an empty table stays empty.
    """
    row = fresh(docs, "_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())  # docs is a table that was read, so numbers stay
    found = cut_lineage(ngram_join.jaccard_components(numbered, words=5, num=80, den=100, id_column=row).filter("n_shingles > 0"))
    ids = numbered.select(F.col(row).alias("doc_id"), F.col("doc_id").alias("id"))
    first = found.join(ids, "doc_id").groupBy("component_id").agg(
        F.min(F.struct(F.col("id").isNull(), "id", F.col("doc_id").alias("row"))).alias("first"), F.count("*").alias("n")).filter("n > 1")
    gone = cut_lineage(found.join(first, "component_id").filter("doc_id <> first.row").select(F.col("doc_id").alias(row)))
    return ngram_join.without(numbered, gone).select(*docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no near copy of a benchmark item.

    Of rows that share an id, or have none, only those whose own text leaks go. Null and empty texts and columns of
    any name are kept; an empty table or benchmark drops nothing.
    """
    return decontamination.without_leaks(renamed(docs), table(spark, sf_dir, "benchmark")).toDF(*docs.columns)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind; n_chars, if there, follows the text. A null text stays null.

    Texts are read whole; repeated rows and columns of any name are kept; an empty table stays empty.
    """
    names, plain = docs.columns, renamed(docs)
    added = pii.added_spans(pii.keyed(plain, "doc_id", "text"))
    held = plain.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62)))).withColumn(
        "_key", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    spans = F.concat(*pii.base_spans(F.col("text")).values())
    joined = held.join(added, ["_id", "_key"], "left").withColumn("_spans", F.when(F.col("text").isNotNull(), F.concat(
        spans, F.coalesce("_added", F.array().cast(f"array<{pii.SPAN}>")))))
    some = F.size("_spans") > 0
    changed = joined.withColumn("text", F.when(some, pii.redacted(F.col("text"), F.col("_spans"))).otherwise(F.col("text")))
    if "n_chars" in names:
        size = f"c{names.index('n_chars')}"
        changed = changed.withColumn(size, F.when(some, F.length("text").cast("long")).otherwise(F.col(size)))
    return changed.select(*plain.columns).toDF(*names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", not_toxic), ("ngram_join", one_of_each), ("decontamination", without_leaks),
          ("personal_data", masked), ("packing", packed)]
ORACLE_SQL = None  # a fitted model and a tokenizer; tests/llm compare the stages with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Every stage is written under the shared checkpoint folder and read again."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
