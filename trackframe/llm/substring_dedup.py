"""Removal of repeated passages, by sliding spans of sentences.

Sentences of more than LONG words are divided into pieces: of every WINDOW words in a row, the one with the smallest
hash starts a piece (the last one on ties), so pieces have at most WINDOW words and are cut alike wherever the same
words stand. From every sentence or piece on, and up to every one, the shortest run of at least MIN_SENTENCES of them
with at least MIN_WORDS words is a span. Spans are hashed and joined over all documents; the first place of a span
(by id, then place) stays, and sentences and pieces that any later place covers are removed.

Of a run of words at most max(LONG, 2 * WINDOW - 1) = 16 at either end lie in a sentence that may be cut otherwise
elsewhere, so any run of 50 words shares at least 18 whole ones, which hold a span.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackframe.session import cut_lineage

MIN_SENTENCES = 2
MIN_WORDS = 12
LONG = 16
WINDOW = 8
WORD = re.compile(r"\S+")
END = re.compile(r"(?:[.!?]+(?=\s)|\n)\s*")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Places of the sentences, with the white space behind them; together they are the whole text."""
    out, start = [], 0
    for m in END.finditer(text or ""):
        out.append((start, m.end()))
        start = m.end()
    if text and start < len(text):
        out.append((start, len(text)))
    return out


def _starts(words: list[str]) -> list[int]:
    """Words that start a piece, without the first: the smallest by hash of some WINDOW words in a row."""
    h = [zlib.crc32(w.encode()) for w in words]
    out, least = [], -1
    for at in range(len(h) - WINDOW + 1):
        new = at + WINDOW - 1
        if least < at:
            least = min(range(at, new + 1), key=lambda i: (h[i], -i))
        elif h[new] <= h[least]:
            least = new
        if least and (not out or out[-1] != least):
            out.append(least)
    return out


def pieces(text: str | None) -> list[tuple[int, int, int]]:
    """Places of the sentences, long ones divided, and the number of the sentence each is of."""
    out = []
    for number, (start, end) in enumerate(sentences(text)):
        words = text[start:end].lower().split()
        if len(words) > LONG:
            places = [m.start() for m in WORD.finditer(text, start, end)]
            for at in _starts(words):
                out.append((start, places[at], number))
                start = places[at]
        out.append((start, end, number))
    return out


def spans(text: str | None, least: int = MIN_SENTENCES, words: int = MIN_WORDS) -> list[tuple[int, int, int, bool]]:
    """(hash, first piece, last piece, again) of every span; letter case and white space do not count. Again are those
    that repeat an earlier one of the text, but not inside a single sentence one that they overlap: a run of one word
    is one passage."""
    cut = pieces(text)
    parts = [" ".join(text[a:b].lower().split()) for a, b, _ in cut]
    sizes = [p.count(" ") + 1 if p else 0 for p in parts]
    ends, end, total = [], 0, 0
    for first in range(len(parts)):
        while end < len(parts) and (end - first < least or total < words):
            total += sizes[end]
            end += 1
        if end - first < least or total < words:
            break
        ends.append(end)
        total -= sizes[first]
    # up to a piece where no such run ends, from the last start whose run ends before it
    runs = []
    for first, end in enumerate(ends):
        after = ends[first + 1] if first + 1 < len(ends) else len(parts) + 1
        runs += [(first, e) for e in range(end, max(end + 1, min(after, len(parts) + 1)))]
    out, met = [], {}
    for first, end in runs:
        mark = int.from_bytes(hashlib.blake2b("\n".join(parts[first:end]).encode(), digest_size=8).digest(), "little", signed=True)
        before = met.get(mark)
        joined = before is not None and before >= first and cut[first][2] == cut[end - 1][2]
        out.append((mark, first, end - 1, before is not None and not joined))
        met[mark] = end - 1
    return out


def _places(docs: DataFrame, least: int, words: int) -> DataFrame:
    """mark, doc_id, again: every span of a row once, and whether the row repeats it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                met: dict[int, bool] = {}
                for mark, _, _, again in spans(text.as_py(), least, words):
                    met[mark] = met.get(mark, False) or again
                out[0] += met.keys()
                out[1] += [doc] * len(met)
                out[2] += met.values()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.bool_()))],
                                             ["mark", "doc_id", "again"])

    return docs.select("doc_id", "text").mapInArrow(find, "mark long, doc_id long, again boolean")


def without_repeats(docs: DataFrame, least: int = MIN_SENTENCES, words: int = MIN_WORDS, id_column: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Documents that lose sentences: doc_id, n_sentences, n_removed, removed (numbers of sentences), first_ids
    (documents where the removed spans stay), text (what is left). Each piece of a long sentence counts as one.

    Rows that share an id are one document, so they are not repeats of each other, but repeats inside each row
    are. A null id comes after all others. Texts with fewer words or sentences than a span, null and empty ones
    never lose any.
    """
    last_id = (1 << 63) - 1
    source = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(last_id)).alias("doc_id"),
                         F.col(text).cast("string").alias("text"))
    places = cut_lineage(_places(source, least, words))
    # nearly all spans stand once: one small number beside the first id is enough to leave them out
    firsts = places.groupBy("mark").agg(F.min("doc_id").alias("first_id"),
                                        F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("times"))
    firsts = firsts.filter("times > 1").select("mark", "first_id")
    covered = places.join(firsts, "mark").filter((F.col("doc_id") > F.col("first_id")) | F.col("again"))
    lost = covered.groupBy("doc_id").agg(
        F.collect_set(F.struct("mark", (F.col("doc_id") > F.col("first_id")).alias("later"))).alias("spans"),
        F.collect_set("first_id").alias("first_ids"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_sentences", "n_removed", "removed", "first_ids", "text"]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string())
        for batch in batches:
            rows = []
            for doc, value, found, first_ids in zip(*(c.to_pylist() for c in batch.columns)):
                later = {s["mark"]: s["later"] for s in found}
                drop = {i for mark, first, last, again in spans(value, least, words)  # of this row, where rows share an id
                        if mark in later and (again or later[mark]) for i in range(first, last + 1)}
                parts = pieces(value)
                if drop:
                    rows.append((None if doc == last_id else doc, len(parts), len(drop), sorted(drop), sorted(first_ids),
                                 "".join(value[a:b] for i, (a, b, _) in enumerate(parts) if i not in drop)))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return source.join(lost, "doc_id").select("doc_id", "text", "spans", "first_ids").mapInArrow(
        remove, "doc_id long, n_sentences long, n_removed long, removed array<int>, first_ids array<long>, text string")
