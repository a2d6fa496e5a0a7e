"""Quartile bucket digests of documents, and their likeness.

A digest counts the byte triplets of a text in hashed buckets and keeps, for every bucket, the quartile its
count falls in, together with the length on a logarithmic scale. Two digests are compared by a difference
score that each bucket and the length can only raise by a bounded amount.

The text that follows a document by id is found inside ranges of the order, which Spark chooses by count, so that
texts move once and neither a hot id nor ids far apart fill a task. Only the last row of a range and the first row of
the next meet in a join.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trackframe.llm.texts import partitions_of, text_of
from trackframe.session import cut_lineage

BUCKETS = 256
BLOCK = 512           # ranges whose borders are ordered together
TIE_CHARS = 200       # of a text, that order rows of one id
SEGMENT = 1 << 22     # bytes whose triplets are counted at once
LENGTH_WEIGHT = 4     # difference of one doubling of the length, at most LENGTH_MOST in all
LENGTH_MOST = 64
SCALE = 384           # difference from which the likeness is 0

_SPREAD = np.random.default_rng(11).permutation(256).astype(np.uint32)


def counts(text: bytes) -> np.ndarray:
    """Byte triplets by bucket; fewer than three bytes have none."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text) - 2, SEGMENT):
        b = np.frombuffer(text, np.uint8, min(SEGMENT + 2, len(text) - at), at)
        s = _SPREAD[b]
        mix = s[:-2] * np.uint32(0x9E3779B1) + s[1:-1] * np.uint32(0x85EBCA6B) + s[2:] * np.uint32(0xC2B2AE35)
        total += np.bincount((mix * np.uint32(0x27D4EB2F)) >> np.uint32(24), minlength=BUCKETS)
    return total


def digest(text: bytes) -> str:
    """Two hex digits for the length and two bits per bucket."""
    n = counts(text)
    borders = np.sort(n)[[BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4]]
    codes = (n[:, None] > borders).sum(axis=1).astype(np.uint8)
    size = min(255, round(4 * math.log2(len(text) + 1)))
    packed = codes.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    return f"{size:02x}{packed.astype(np.uint8).tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 from a difference of SCALE on."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(v), np.uint8) for v in (a, b))
    length = min(LENGTH_MOST, LENGTH_WEIGHT * abs(int(x[0]) - int(y[0])) / 4)
    p, q = ((v[1:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3 for v in (x, y))
    return max(0.0, 1.0 - (length + int(np.abs(p.astype(int) - q).sum())) / SCALE)


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the start of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


FIELDS = {"doc_id": pa.int64(), "block": pa.int64(), "role": pa.string(), "n_chars": pa.int64(), "text": pa.string(),
          "fingerprint": pa.string(), "edited_sha256": pa.string(), "edited_fingerprint": pa.string(),
          "near_edited": pa.float64(), "near_next": pa.float64()}
SCHEMA = ("doc_id long, block long, role string, n_chars long, text string, fingerprint string, edited_sha256 string, "
          "edited_fingerprint string, near_edited double, near_next double")


def _compared(text: str, mark: str, following: str, following_mark: str) -> tuple:
    new = edited(text, following).encode()
    new_mark = digest(new)
    return hashlib.sha256(new).hexdigest(), new_mark, likeness(mark, new_mark), likeness(mark, following_mark)


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order with what follows them. The last row of a range is returned as its `tail`, to be
    completed, and its first row a second time as its `head`, both with their texts."""
    from pyspark import TaskContext

    out: list[tuple] = []
    held, block = None, TaskContext.get().partitionId()

    def record(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), FIELDS.values())], list(FIELDS))

    def tail():
        block, doc, text, mark = held
        out.append((doc, block, "tail", len(text), text, mark, None, None, None, None))

    for batch in batches:
        for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            mark = digest(text.encode())
            if held is None:
                out.append((doc, block, "head", len(text), text, mark, None, None, None, None))
            else:
                out.append((held[1], block, "row", len(held[2]), None, held[3], *_compared(held[2], held[3], text, mark)))
            held = (block, doc, text, mark)
        if out:
            yield record(out)
            out = []
    if held is not None:
        tail()
        yield record(out)


def _next_blocks(blocks: DataFrame) -> DataFrame:
    """block and following of every block; the last is followed by the first. Blocks are ordered in ranges, so
    that what one task orders as a whole is one row per BLOCK blocks."""
    ranged = blocks.withColumn("_range", F.floor(F.col("block") / F.lit(BLOCK)))
    tops = ranged.groupBy("_range").agg(F.min("block").alias("_top"))
    whole = Window.orderBy("_range")
    tops = tops.select("_range", F.coalesce(F.lead("_top").over(whole), F.min("_top").over(whole)).alias("_after"))
    inside = Window.partitionBy("_range").orderBy("block")
    return (ranged.withColumn("_next", F.lead("block").over(inside)).join(tops, "_range")
            .select("block", F.coalesce("_next", "_after").alias("following")))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A null text counts as empty. Rows follow each other by id, then the first TIE_CHARS characters of the text, then
    their place in the table, a null id first; the last row is followed by the first, a single row by itself. Every
    repeated row is kept. An empty table gives no rows. Other columns are not read.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text).alias("text"))
    placed = source.select("doc_id", "text", F.substring("text", 1, TIE_CHARS).alias("start"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "start", "row"]
    found = cut_lineage(placed.repartitionByRange(partitions_of(docs.sparkSession), *order).sortWithinPartitions(*order)
                        .select("doc_id", "text").mapInArrow(_in_blocks, SCHEMA))
    result = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    heads = found.filter("role = 'head'")
    order = _next_blocks(heads.select("block"))
    ends = (found.filter("role = 'tail'").join(order, "block").select("following", "doc_id", "text", "n_chars", "fingerprint")
            .join(heads.select(F.col("block").alias("following"), F.col("text").alias("_text"), F.col("fingerprint").alias("_mark")),
                  "following"))

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text, size, mark, after, after_mark = (c.to_pylist() for c in batch.columns)
            made = [_compared(*x) for x in zip(text, mark, after, after_mark)]
            columns = [doc, size, [m[0] for m in made], mark, [m[1] for m in made], [m[2] for m in made], [m[3] for m in made]]
            yield pa.RecordBatch.from_arrays([pa.array(c, FIELDS[k]) for c, k in zip(columns, result)], result)

    completed = ends.select("doc_id", "text", "n_chars", "fingerprint", "_text", "_mark").mapInArrow(
        complete, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                  "near_edited double, near_next double")
    return found.filter("role = 'row'").select(*result).unionByName(completed)
