"""Packing of documents into sequences by minimum bin slack.

Every document is cut into pieces of the full capacity and one rest. Full pieces are sequences by
themselves. Of the rests only a histogram of their lengths (at most `capacity` rows, whatever the corpus)
reaches the driver, where each window is filled by a subset-sum program over bitsets; a pattern found is
used as often as its lengths last, so the number of patterns is bounded by the number of lengths. Rests get
a rank among those of their length, in blocks that keep a frequent length out of one task, and a join with
the plan's rank ranges gives each rest its sequence and offset.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trackframe.llm.texts import MARKS, byte_letters, partitions_of, text_of
from trackframe.session import cut_lineage

CACHED = 800_000
LONGEST_KEY = 64
_workers: dict = {}

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordIds(dict):
    """Ids of white-space separated words as little-endian bytes, filled as words come.

    Only for tokenizers that drop white space and letter case, and never join tokens across white space or
    between a letter or digit and the marks after it. Where the tokenizer is byte-level, a word of letters goes to
    the model without normalising and cutting.
    """

    def __init__(self, path: str, cached: int):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), cached
        self.part = self.tokenizer.model.tokenize if takes_letters(json.loads(self.tokenizer.to_str())) else None

    def __missing__(self, word: bytes) -> bytes:
        ids = self.made(word)
        if len(word) <= LONGEST_KEY:
            if len(self) >= self.limit:
                self.clear()
            self[word] = ids
        return ids

    def made(self, word: bytes) -> bytes:
        text = word.decode()
        if text.isalpha() and (text.isascii() or max(text) < "\u0180" and "\u0130" not in text):
            small = text.lower()
            if small != text:
                return self[small.encode()]
            if self.part:
                tokens = self.part(small if text.isascii() else byte_letters(small))
                return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        else:
            stem = text.rstrip(MARKS)
            # normalising may add marks of its own to other letters
            plain = stem[-1:].isalnum() and stem[-1] < "\u0180" and stem[-1] != "\u0130"
            if plain and (stem.isalnum() and len(stem) < len(text) or text[len(stem):] in (".", ",")):
                return self[stem.encode()] + self[text[len(stem):].encode()]
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.__getitem__, words))


LETTER_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def takes_letters(made: dict) -> bool:
    """Whether the model of a tokenizer, given as its file, gets each run of small letters as it is, byte by byte."""
    forms = (made.get("normalizer") or {}).get("normalizers", [])
    cuts = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return ([f["type"] for f in forms] == ["NFC", "Replace", "Lowercase"] and forms[1]["pattern"] == {"Regex": r"\s+"}
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": LETTER_CUT}
            and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
            and made["model"]["type"] == "BPE" and not made["model"].get("dropout"))


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_column: str = "doc_id",
              text: str = "text") -> DataFrame:
    """Pieces of at most `capacity` ids of every document, with a checksum of their ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _workers.get("path") != tokenizer_path:
            _workers.update(path=tokenizer_path, words=WordIds(tokenizer_path, CACHED))
        words, end, step = _workers["words"], np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.of(text.as_py().encode().split()) + end
                view = memoryview(ids)
                for at in range(0, len(ids), step):
                    part = view[at:at + step]
                    for column, v in zip(out, (doc, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_column).cast("long"), text_of(text)).mapInArrow(cut, PIECES)


def _chosen(counts: dict[int, int], room: int, lengths: list[int]) -> dict[int, int]:
    """The multiset of remaining lengths whose sum comes closest to room, by a bitset for every step back.

    Bit s of a bitset says that the sum s can be reached. A length with n copies left is tried in parts of
    1, 2, 4, ... copies, so that each count up to n is a sum of parts.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        left, part = min(counts[length], room // length), 1
        while left > 0:
            part = min(part, left)
            grown = reach | (reach << (length * part)) & mask
            if grown != reach:
                steps.append((length, part, reach))
                reach = grown
            left, part = left - part, part * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            total -= length * part
            used[length] = used.get(length, 0) + part
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, copies in a sequence, offset of the first copy).

    Ranks of a length from first to end fill the pattern's sequences one after the other.
    """
    counts = {k: n for k, n in histogram.items() if n > 0}
    taken = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    while counts:
        lengths = sorted(counts, reverse=True)
        seed = lengths[0]
        counts[seed] -= 1
        pattern = _chosen(counts, capacity - seed, lengths)
        counts[seed] += 1
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in pattern.items())
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            rows.append((length, taken[length], taken[length] + n * times, sequence, n, offset))
            taken[length] += n * times
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
            offset += n * length
        sequence += times
    return rows


def ranked(pieces: DataFrame, spark: SparkSession) -> DataFrame:
    """pieces with a rank from 0 among those of the same length; a frequent length is spread over blocks."""
    blocks = partitions_of(spark)
    blocked = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", "ids_crc32"), F.lit(blocks)))
    sizes = blocked.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_block").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")
    return (blocked.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["length", "_block"])
            .withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_block", "_before"))


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_column: str = "doc_id",
           text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id; null and empty texts are end_id alone. Repeated rows are packed each,
    a null id stays null. Needs a tokenizer that drops white space. An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = cut_lineage(pieces_of(docs, tokenizer_path, capacity, end_id, id_column, text))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(histogram, capacity)
    spans = spark.createDataFrame(rows, "length long, _first long, _end long, _sequence long, _copies long, _offset long")
    known = F.broadcast(spans)  # a few rows per length: bounded by the capacity
    found = ranked(pieces, spark).join(
        known.withColumnRenamed("length", "_length"),
        (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    place = F.col("_rank") - F.col("_first")
    return found.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_sequence") + F.floor(place / F.col("_copies")).cast("long")).alias("sequence_id"),
        (F.col("_offset") + F.pmod(place, F.col("_copies")) * F.col("length")).alias("offset"))
