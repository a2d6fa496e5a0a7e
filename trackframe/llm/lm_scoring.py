"""Masked pseudo-likelihood scores of documents.

Every token of a text is predicted from the tokens on both sides by a small window network: embeddings of the
RADIUS tokens before and after, by position, are added and passed through tanh to a softmax over word classes.
A frequent word is a class by itself; the others share classes by their hash, in which a word's own share comes
from the whole corpus' counts. log P(class | both sides) + log P(word | class), summed over the document,
is its score.

Counting and training read every whole text. Words are counted in tasks and summed by Spark. The network is trained
in numpy inside tasks: each task makes one pass over its rows from the same start, and the weights are
averaged by the tokens they have seen. What is sent grows with the number of tasks and of distinct words.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackframe.session import cut_lineage

CLASSES = 64        # the pad class 0, FREQUENT words, and classes of other words by hash
FREQUENT = 40
RADIUS = 2
WIDTH = 16          # of the hidden layer
BATCH = 2_048       # tokens of a step
RATE = 0.5
HELD = 400_000      # distinct words a task counts before it hands them on
SMOOTH = 0.5        # added to a word's count
PARTS = 1 << 20     # fixed-point steps of averaged weights, so that their order does not matter
TABLE = 200_000     # words whose counts are sent to every worker; the counts of all others are joined

_workers: dict = {}


def words_of(text: str | None) -> list[str]:
    """Tokens are the lower-cased words between white space, with the marks that touch them."""
    return text.lower().split() if text else []


def corpus_counts(docs: DataFrame) -> DataFrame:
    """word and n over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(seen):
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                              ["word", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                seen.update(words_of(value.as_py()))
                if len(seen) > HELD:
                    yield handed(seen)
                    seen = Counter()
        yield handed(seen)

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary(dict):
    """Class by word; others than the frequent ones are hashed when asked for, and kept while there is room."""

    def __init__(self, frequent: list[str], room: int = 500_000):
        super().__init__((w, 1 + i) for i, w in enumerate(frequent))
        self.first, self.room = 1 + len(frequent), room

    def __missing__(self, word: str) -> int:
        c = self.first + zlib.crc32(word.encode()) % (CLASSES - self.first)
        if len(self) < self.room:
            self[word] = c
        return c


def start_weights(shares: np.ndarray, seed: int = 7) -> list[np.ndarray]:
    """By position the embeddings into the hidden layer, its bias, the output layer and its bias, which starts
    at the classes' shares of the corpus."""
    rng = np.random.default_rng(seed)
    return [rng.normal(0, 0.3, (2 * RADIUS, CLASSES, WIDTH)).astype(np.float32), np.zeros(WIDTH, np.float32),
            rng.normal(0, 0.1, (WIDTH, CLASSES)).astype(np.float32), np.log(shares).astype(np.float32)]


def windows(classes: np.ndarray) -> np.ndarray:
    """Classes around every token, pads beyond the ends: one row per position of the window."""
    padded = np.concatenate([np.zeros(RADIUS, np.int64), classes, np.zeros(RADIUS, np.int64)])
    offsets = [*range(RADIUS), *range(RADIUS + 1, 2 * RADIUS + 1)]
    return np.stack([padded[o:o + len(classes)] for o in offsets])


def _forward(weights, around):
    hidden = np.tanh(sum(weights[0][p][around[p]] for p in range(len(around))) + weights[1])
    logits = hidden @ weights[2] + weights[3]
    logits -= logits.max(axis=1, keepdims=True)
    share = np.exp(logits)
    total = share.sum(axis=1, keepdims=True)
    return hidden, logits - np.log(total), share / total


def step(weights: list[np.ndarray], around: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One gradient step on a batch; the embeddings' gradients are summed by one-hot products."""
    n = len(target)
    hidden, _, error = _forward(weights, around)
    error[np.arange(n), target] -= 1
    back = (error @ weights[2].T) * (1 - hidden * hidden)
    weights[2] -= rate / n * (hidden.T @ error)
    weights[3] -= rate / n * error.sum(axis=0)
    weights[1] -= rate / n * back.sum(axis=0)
    hot, rows = np.zeros((CLASSES, n), np.float32), np.arange(n)
    for p in range(len(around)):
        hot[around[p], rows] = 1
        weights[0][p] -= rate / n * (hot @ back)
        hot[around[p], rows] = 0


def log_shares(weights, classes: np.ndarray) -> np.ndarray:
    """log P(class | both sides) of every token."""
    out = np.empty(len(classes), np.float64)
    around = windows(classes)
    for at in range(0, len(classes), BATCH):
        part = slice(at, at + BATCH)
        out[part] = _forward(weights, around[:, part])[1][np.arange(len(classes[part])), classes[part]]
    return out


def trained(docs: DataFrame, frequent: list[str], shares: np.ndarray, seed: int = 7) -> list[np.ndarray]:
    """Weights averaged over the tasks, each having passed over all its rows once."""
    shapes = [w.shape for w in start_weights(shares, seed)]

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known, seen = start_weights(shares, seed), Vocabulary(frequent), 0
        held_around, held_target, size = [], [], 0

        def learn():
            around, target = np.concatenate(held_around, axis=1), np.concatenate(held_target)
            for at in range(0, len(target), BATCH):
                step(weights, around[:, at:at + BATCH], target[at:at + BATCH], RATE)

        for batch in batches:
            for value in batch.column(0):
                classes = np.fromiter(map(known.__getitem__, words_of(value.as_py())), np.int64)
                if not len(classes):
                    continue
                held_around.append(windows(classes))
                held_target.append(classes)
                size, seen = size + len(classes), seen + len(classes)
                if size >= BATCH:
                    learn()
                    held_around, held_target, size = [], [], 0
        if size:
            learn()
        flat = np.concatenate([w.ravel() for w in weights]).astype(np.float64)
        fixed = np.rint(flat * PARTS).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(flat)), pa.int64()), pa.array(fixed, pa.int64()), pa.array(np.full(len(flat), seen), pa.int64())],
            ["place", "fixed", "seen"])

    total = F.sum((F.col("fixed").cast("decimal(19,0)") * F.col("seen").cast("decimal(19,0)")).cast("decimal(38,0)"))
    got = (docs.select("text").mapInArrow(train, "place long, fixed long, seen long").groupBy("place")
           .agg(total.alias("total"), F.sum("seen").alias("seen"))
           .select("place", (F.col("total").cast("double") / F.greatest("seen", F.lit(1)) / PARTS).alias("value"))
           .toArrow().sort_by("place"))  # one row per weight
    flat, out, at = got["value"].to_numpy(), [], 0
    for start, shape in zip(start_weights(shares, seed), shapes):
        size = int(np.prod(shape))
        out.append(flat[at:at + size].astype(np.float32).reshape(shape) if len(flat) else start)
        at += size
    return out


def scores(docs: DataFrame, id_column: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over the tokens) and mean_log_likelihood of every row.

    Null texts and texts without tokens have 0 tokens, sum 0 and a null mean. Repeated rows are scored alike and
    count as often as they stand in the corpus. An empty table gives no rows. Weights depend on how the input
    is split into tasks, as one pass per task is averaged.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counts = cut_lineage(corpus_counts(source))
    # the frequent words, and how many tokens and words each class of others has: CLASSES rows in all
    best = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    frequent = [r["word"] for r in best]
    first = 1 + len(frequent)
    others = counts.filter(~F.col("word").isin(frequent)) if frequent else counts
    by_class = {r["c"]: (r["n"], r["k"]) for r in others.groupBy(
        (F.lit(first) + F.crc32(F.encode("word", "UTF-8")) % (CLASSES - first)).cast("int").alias("c")).agg(
            F.sum("n").alias("n"), F.count("*").alias("k")).collect()}
    # words that a task will meet often enough to be worth a table. Others are scored as met once, which the join
    # below corrects for those met more often
    several = others.filter("n > 1")
    top = several.orderBy(F.desc("n"), "word").limit(TABLE).toArrow()
    beyond = top.num_rows == TABLE
    met = np.ones(CLASSES)  # a class that was never met counts once
    for c, n in [*enumerate((r["n"] for r in best), 1), *((c, n) for c, (n, _) in by_class.items())]:
        met[c] += n
    weights = trained(source, frequent, met / met.sum(), seed)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, by_class, top["word"], top["n"], weights))
    key = uuid.uuid4().hex

    @F.arrow_udf("n_tokens long, log_likelihood double, missed array<struct<word: string, times: int>>")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if _workers.get("key") != key:
            frequent, by_class, top_words, top_counts, weights = shared.value
            known = Vocabulary(frequent)
            total = np.zeros(CLASSES)
            for c, (n, k) in by_class.items():
                total[c] = np.log(n + SMOOTH * k)
            table = {w: np.log(n + SMOOTH) for w, n in zip(top_words.to_pylist(), top_counts.to_pylist())}
            table.update((w, 0.0) for w in frequent)  # a class of its own
            _workers.update(key=key, known=known, total=total, table=table, weights=weights)
        known, total, table, weights = (_workers[k] for k in ("known", "total", "table", "weights"))
        rare = float(np.log(1 + SMOOTH))
        for part in parts:
            n, sums, missed, times, ends = [], [], [], [], [0]
            for value in part:
                words = words_of(value.as_py())
                classes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                own = np.fromiter((table.get(w, rare) for w in words), np.float64, len(words))
                n.append(len(words))
                sums.append(float((log_shares(weights, classes) + own - total[classes]).sum()) if words else 0.0)
                others = Counter(w for w in words if w not in table) if beyond else {}
                missed += others.keys()
                times += others.values()
                ends.append(len(missed))
            pairs = pa.StructArray.from_arrays([pa.array(missed, pa.string()), pa.array(times, pa.int32())], ["word", "times"])
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(sums, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)],
                ["n_tokens", "log_likelihood", "missed"])

    scored = source.select("doc_id", score("text").alias("s")).select("doc_id", "s.*")
    if beyond:
        scored = cut_lineage(scored.withColumn("_row", F.monotonically_increasing_id()))
        more = F.col("times") * (F.log(F.col("n") + F.lit(SMOOTH)) - F.lit(float(np.log(1 + SMOOTH))))
        added = (scored.select("_row", F.inline("missed")).join(several, "word").groupBy("_row").agg(F.sum(more).alias("_more")))
        scored = scored.drop("missed").join(added, "_row", "left").withColumn(
            "log_likelihood", F.col("log_likelihood") + F.coalesce("_more", F.lit(0.0)))
    return scored.select(
        "doc_id", "n_tokens", F.round("log_likelihood", 6).alias("log_likelihood"),
        F.when(F.col("n_tokens") > 0, F.round(F.col("log_likelihood") / F.col("n_tokens"), 6)).alias("mean_log_likelihood"))
