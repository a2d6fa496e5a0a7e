"""Toxicity as ordered severity grades: a cumulative-link (proportional odds) regression on sparse word features.

P(grade <= k) = sigmoid(t_k - w.x) with one weight vector for all ordered thresholds t_1 < t_2 < ...; the
result is the expected grade. Features are the words that lean most clearly to higher grades,
weighted 1 + log(count), with weights of at least 0. Choosing words, fitting and grading use a bounded sample of labelled rows
(`sample`, the rows with the smallest hash of the id); scoring reads every whole text of the table.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackframe.llm.shingles import shingle_set

SAMPLE = 20_000   # labelled rows used for fitting
WORDS = 1_500     # features
LEAST = 5         # sample documents above grade 0 a feature occurs in, and
SHARE = 0.01      # the share of them
CLEAR = 3.0       # standard errors by which its log odds differ from 0
ROUNDS = 600
WORD = re.compile(r"[^\W\d_]+")

_workers: dict = {}


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: str, sample: int, id_column: str, text: str) -> DataFrame:
    """text and grade of at most `sample` labelled ids; of an id labelled twice the higher grade counts. Texts
    that agree in the smallest hash of their runs of 4 words (copies, and most near copies) count once."""
    chosen = (labels.select(F.col(id_column).cast("long").alias("_id"), F.col(grade).cast("int").alias("grade")).dropna()
              .groupBy("_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = (docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text).cast("string").alias("text"))
            .join(F.broadcast(chosen), "_id"))  # at most `sample` rows of two numbers
    @F.arrow_udf("long")
    def least_run(texts: pa.Array) -> pa.Array:
        sets = (shingle_set(v.as_py(), 4) for v in texts)
        return pa.array([int(s[0]) >> 1 if len(s) else -1 for s in sets], pa.int64())

    return (rows.withColumn("_least", least_run("text")).groupBy("_least")
            .agg(F.min_by(F.struct("_id", "text", "grade"), F.struct("_id", "text")).alias("r")).select("r.*"))


def telling_words(rows: DataFrame, number: int = WORDS, least: int = LEAST) -> dict[str, float]:
    """The words that most clearly lean to grades above 0, with their log odds in standard errors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(low, high):
            keys = list(low | high)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([low[k] for k in keys], pa.int64()),
                 pa.array([high[k] for k in keys], pa.int64())], ["word", "low", "high"])

        low, high = Counter(), Counter()
        for batch in batches:
            for value, grade in zip(batch.column(0), batch.column(1)):
                (high if grade.as_py() > 0 else low).update(set(words_of(value.as_py())))
            if len(low) + len(high) > 300_000:
                yield flushed(low, high)
                low, high = Counter(), Counter()
        yield flushed(low, high)

    total = rows.agg(F.count(F.when(F.col("grade") > 0, 1)).alias("high"), F.count("*").alias("n")).first()
    n_high, n_low = total["high"], total["n"] - total["high"]
    if not n_high or not n_low:
        return {}
    a, b = (F.col("high") + 0.5) / (n_high + 1.0), (F.col("low") + 0.5) / (n_low + 1.0)
    odds = F.log(a / (1.0 - a + 1e-9)) - F.log(b / (1.0 - b + 1e-9))
    spread = F.sqrt(1.0 / (F.col("high") + 0.5) + 1.0 / (F.col("low") + 0.5))
    found = (rows.select("text", "grade").mapInArrow(count, "word string, low long, high long")
             .groupBy("word").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
             .filter(F.col("high") >= max(least, SHARE * n_high))
             .select("word", F.round(odds / spread, 9).alias("z"))
             .filter(F.col("z") >= CLEAR).orderBy(F.desc("z"), "word").limit(number).collect())
    return {r["word"]: r["z"] for r in found}


def features(text: str | None, index: dict[str, int]) -> tuple[list[int], list[float]]:
    """Positions and values of a text's features."""
    seen = Counter(index[w] for w in words_of(text) if w in index)
    return list(seen), [1.0 + float(np.log(c)) for c in seen.values()]


def fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int,
        rounds: int = ROUNDS, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by gradient steps on the mean log likelihood (Adam)."""
    n, k = len(grades), int(grades.max(initial=1))
    share = np.clip(np.array([(grades <= j).mean() for j in range(k)]), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    upper, lower = grades < k, grades > 0
    for step in range(1, rounds + 1):
        t = np.concatenate([p[width:width + 1], p[width] + np.cumsum(np.exp(p[width + 1:]))])
        score = np.bincount(rows, values * p[columns], n)
        hi = np.where(upper, 1 / (1 + np.exp(-(t[np.minimum(grades, k - 1)] - score))), 1.0)
        lo = np.where(lower, 1 / (1 + np.exp(-(t[np.maximum(grades - 1, 0)] - score))), 0.0)
        prob = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / prob, lo * (1 - lo) / prob  # zero where there is no threshold
        d_score = (d_hi - d_lo) / n
        g_t = (np.bincount(np.minimum(grades, k - 1), -d_hi * upper, k)
               + np.bincount(np.maximum(grades - 1, 0), d_lo * lower, k)) / n
        after = np.cumsum(g_t[::-1])[::-1]  # a step in a gap moves all later thresholds
        g = np.concatenate([np.bincount(columns, values * d_score[rows], width) + penalty * p[:width], after[:1],
                            after[1:] * np.exp(p[width + 1:])])
        m, v = 0.9 * m + 0.1 * g, 0.97 * v + 0.03 * g * g
        p = p - 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.97 ** step)) + 1e-8)
        p[:width] = np.maximum(p[:width], 0)  # every feature leans to higher grades
    return p[:width], np.concatenate([p[width:width + 1], p[width] + np.cumsum(np.exp(p[width + 1:]))])


def grade_shares(score: float, thresholds: np.ndarray) -> np.ndarray:
    below = np.concatenate([[0.0], 1 / (1 + np.exp(-(thresholds - score))), [1.0]])
    return np.diff(below)


def fitted_model(docs: DataFrame, labels: DataFrame, grade: str, refine: int = 1, sample: int = SAMPLE,
                 id_column: str = "doc_id", text: str = "text") -> dict:
    """Vocabulary, weights and thresholds, from the integer grades (0 and up) of labels' column. With refine > 1
    the column only tells 0 from more: rows above 0 get grades 1 to refine by quantiles of how many telling words
    they hold, those without any grade 1."""
    rows = labelled_sample(docs, labels, grade, sample, id_column, text)
    leaning = telling_words(rows)
    index = {w: i for i, w in enumerate(leaning)}
    def encode(batches):
        for batch in batches:
            found = [features(v.as_py(), index) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c for c, _ in found], pa.list_(pa.int32())),
                 pa.array([x for _, x in found], pa.list_(pa.float64())), batch.column(2)],
                ["_id", "columns", "values", "grade"])

    got = (rows.select("_id", "text", "grade").mapInArrow(
        encode, "_id long, columns array<int>, values array<double>, grade int").toArrow().sort_by("_id"))
    grades = np.asarray(got["grade"], np.int64)
    if not len(grades) or not (grades > 0).any() or not (grades == 0).any():
        return {"index": {}, "weights": np.zeros(0), "thresholds": np.array([50.0])}  # nothing to tell apart: grade 0
    columns = got["columns"].combine_chunks()
    rows, columns = np.repeat(np.arange(len(grades)), np.diff(np.asarray(columns.offsets))), np.asarray(columns.flatten())
    values = np.asarray(got["values"].combine_chunks().flatten())
    if refine > 1:
        mass = np.bincount(rows, values, len(grades))
        some = mass[(grades > 0) & (mass > 0)]
        borders = np.quantile(some, np.arange(1, refine) / refine) if len(some) else np.full(refine - 1, np.inf)
        grades = np.where(grades > 0, 1 + np.searchsorted(borders, mass, side="right"), 0)
    grades = np.unique(grades, return_inverse=True)[1]  # grades that no row has leave no gap
    weights, thresholds = fit(rows, columns, values, grades, len(index))
    return {"index": index, "weights": weights, "thresholds": thresholds}


def with_severity(docs: DataFrame, model: dict, text: str = "text", column: str = "severity") -> DataFrame:
    """docs with a struct: expected (the expected grade), grade (the most likely one), toxic (P(grade > 0) >= 1/2).

    Null and empty texts are scored without features. Every row and column stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast((list(model["index"]), model["weights"], model["thresholds"]))
    key = uuid.uuid4().hex

    @F.arrow_udf("expected double, grade int, toxic boolean")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if _workers.get("key") != key:
            words, weights, thresholds = shared.value
            _workers.update(key=key, index={w: i for i, w in enumerate(words)}, weights=weights, thresholds=thresholds)
        index, weights, thresholds = (_workers[k] for k in ("index", "weights", "thresholds"))
        for part in parts:
            out = []
            for v in part:
                columns, values = features(v.as_py(), index)
                shares = grade_shares(float(np.dot(values, weights[columns])) if columns else 0.0, thresholds)
                out.append((float(shares @ np.arange(len(shares))), int(shares.argmax()), bool(shares[0] <= 0.5)))
            yield pa.StructArray.from_arrays(
                [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.float64(), pa.int32(), pa.bool_()))],
                ["expected", "grade", "toxic"])

    return docs.withColumn(column, score(F.col(text).cast("string")))


def severities(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, expected_severity, severity and toxic of every row, from labels' column toxic refined to 3 grades."""
    model = fitted_model(docs, labels, "toxic", refine=2, sample=sample)
    scored = with_severity(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", F.round("severity.expected", 6).alias("expected_severity"),
                         F.col("severity.grade").alias("severity"), F.col("severity.toxic").alias("toxic"))
