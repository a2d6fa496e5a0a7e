"""Token counts without tokenizing every text.

Two tiers, both on the map side: a table of the corpus's frequent pre-tokens and their lengths in tokens
is broadcast; what is not in it is encoded once per worker and kept in a bounded cache. No pre-token is
shuffled: tasks exchange only summaries of at most `per_task` rows from which the table is chosen, and the
table decides speed, never results.

A pre-token here is a stretch between single spaces together with the space before it. A byte-level
tokenizer with the usual pattern never joins tokens across that border, except where a space stands
between two other white spaces or where the text holds a special token's string; such texts are encoded whole.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackframe.llm.texts import text_of

FREQUENT = 65_536       # rows of the broadcast table
PER_TASK = 20_000       # rows a task contributes to the choice
CACHED = 400_000        # misses a worker keeps
LONGEST_KEY = 64        # longer pre-tokens are counted but never kept
WIDE_SPACE = re.compile(r"\s \s")

_workers: dict = {}     # of this worker process: the table and the cache of the broadcast in use


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Lengths(dict):
    """Token counts by pre-token: the broadcast tier, and misses as they come."""

    def __init__(self, tokenizer, frequent: dict[str, int], cached: int = CACHED):
        super().__init__(frequent)
        self.tokenizer, self.limit, self.cached = tokenizer, len(frequent) + cached, []
        self.specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def __missing__(self, piece: str) -> int:
        n = self.encode(" " + piece)
        if len(piece) <= LONGEST_KEY:
            if len(self) >= self.limit:
                for k in self.cached:
                    del self[k]
                self.cached = []
            self[piece] = n
            self.cached.append(piece)
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        if WIDE_SPACE.search(text) or any(s in text for s in self.specials):
            return self.encode(text)
        pieces = text.split(" ")
        first = self.encode(pieces[0]) if pieces[0] else 0
        return first + sum(map(self.__getitem__, pieces[1:]))


def frequent_pretokens(docs: DataFrame, text: str = "text", top: int = FREQUENT, per_task: int = PER_TASK) -> list[str]:
    """The most frequent pre-tokens of the whole corpus, by the tasks' summaries."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                seen.update((value.as_py() or "").split(" ")[1:])
                if len(seen) > 10 * per_task:
                    seen = Counter(dict(seen.most_common(5 * per_task)))
        best = [(k, n) for k, n in seen.most_common(per_task) if n > 1 and len(k) <= LONGEST_KEY]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["piece", "n"])

    rows = (docs.select(F.col(text).cast("string").alias("text")).mapInArrow(summary, "piece string, n long")
            .groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(top).collect())
    return [r["piece"] for r in rows]


def with_token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", column: str = "n_tokens",
                      top: int = FREQUENT) -> DataFrame:
    """docs with the number of tokens the tokenizer gives each whole text, without begin or end tokens.

    Null and empty texts have 0 tokens. Every row and column stays; a column named like the result is replaced.
    """
    lengths = Lengths(load(tokenizer_path), {})
    # \x00 separates the strings of the table; a pre-token that holds one stays a miss
    pieces = [p for p in frequent_pretokens(docs, text, top) if "\x00" not in p]
    counts = pa.array([lengths.encode(" " + p) for p in pieces], pa.uint16())
    frequent = docs.sparkSession.sparkContext.broadcast(("\x00".join(pieces).encode(), counts))
    key = (tokenizer_path, uuid.uuid4().hex)

    @F.arrow_udf("long")
    def count(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if _workers.get("key") != key:
            joined, n = frequent.value
            known = dict(zip(joined.decode().split("\x00"), n.to_pylist())) if len(n) else {}
            _workers.update(key=key, lengths=Lengths(load(tokenizer_path), known))
        for part in parts:
            yield pa.array([_workers["lengths"].of(v.as_py()) for v in part], pa.int64())

    return docs.withColumn(column, count(F.col(text).cast("string")))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; null text counts as empty."""
    counted = with_token_counts(docs.select("doc_id", text_of().alias("text")), tokenizer_path)
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
