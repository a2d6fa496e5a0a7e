"""Behaviour classifier: training table, cross-validation, scores and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from trackframe.session import cut_lineage
from trackframe.functions.names import yes_no_label
from trackframe.functions.ordering import value_ranks
from trackframe.schemas import require_columns

# Thresholds of the sweep.
THRESHOLDS = [round(0.10 + 0.05 * i, 2) for i in range(18)]
METRICS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc")


def training_table(features: DataFrame, annotations: DataFrame, columns) -> DataFrame:
    """Features of the annotated trajectories that have a valid label and no missing value."""
    require_columns(annotations, "video_id", "ant_id", "excavating")
    require_columns(features, "video_id", "ant_id", *columns)
    labels = annotations.select("video_id", "ant_id", yes_no_label(F.col("excavating")).alias("label")).dropna()
    return features.join(labels, ["video_id", "ant_id"]).dropna(subset=list(columns))


def fit_classifier(train: DataFrame, columns, label: str = "label") -> PipelineModel:
    """Standardised features, L2 logistic regression, classes weighted to equal mass.

    Weights n / (2 n_class) sum to n, so the penalty 1/n matches unit C on summed losses.
    """
    n, ones = train.agg(F.count("*"), F.sum(label)).first()
    weight = F.when(F.col(label) == 1, n / (2.0 * ones)).otherwise(n / (2.0 * (n - ones)))
    stages = [VectorAssembler(inputCols=list(columns), outputCol="raw"),
              StandardScaler(inputCol="raw", outputCol="features", withMean=True),
              LogisticRegression(labelCol=label, weightCol="w", regParam=1.0 / n, elasticNetParam=0.0,
                                 standardization=False, maxIter=1000)]
    return Pipeline(stages=stages).fit(train.withColumn("w", weight))


def _raw_weights(model: PipelineModel) -> tuple[float, list[float]]:
    """Intercept and weights on unscaled features."""
    scaler, regression = model.stages[1], model.stages[2]
    spread = np.where(scaler.std.toArray() > 0, scaler.std.toArray(), 1.0)
    w = np.where(scaler.std.toArray() > 0, regression.coefficients.toArray(), 0.0) / spread
    return float(regression.intercept - w @ scaler.mean.toArray()), [float(x) for x in w]


def scored(model: PipelineModel, rows: DataFrame, columns, out: str = "excavating_score") -> DataFrame:
    """All rows with their score, null where a feature is missing."""
    intercept, weights = _raw_weights(model)
    margin, whole = F.lit(intercept), F.lit(True)
    for c, w in zip(columns, weights):
        margin = margin + F.lit(w) * F.col(c)
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return rows.withColumn(out, F.when(whole, 1 / (1 + F.exp(-margin))))


FOLDS = 4096        # folds a task takes at once


def _fold_sums(columns: int, places: dict, weights: np.ndarray, class_weights: np.ndarray):
    """Task that adds up, for every fold, loss, gradient and curvature over the rows outside of it."""
    k = columns + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(weights), 1 + k + k * k))
        for batch in batches:
            fold, label, *xs = batch.columns
            own = np.array([places.get(v, -1) for v in fold.to_pylist()])
            y = label.to_numpy(zero_copy_only=False).astype(float)
            x = np.column_stack([np.ones(len(y)), *[c.to_numpy(zero_copy_only=False) for c in xs]])
            pairs = (x[:, :, None] * x[:, None, :]).reshape(len(y), -1)
            for at in range(0, len(weights), FOLDS):
                w = weights[at:at + FOLDS]
                margin = x @ w.T
                size = np.where(y[:, None] == 1, class_weights[at:at + FOLDS, 1], class_weights[at:at + FOLDS, 0])
                inside = (own >= at) & (own < at + len(w))
                size[np.flatnonzero(inside), own[inside] - at] = 0.0
                chance = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                part = total[at:at + len(w)]
                part[:, 0] += (size * (np.logaddexp(0, margin) - y[:, None] * margin)).sum(axis=0)
                part[:, 1:1 + k] += (size * (chance - y[:, None])).T @ x
                part[:, 1 + k:] += (size * chance * (1 - chance)).T @ pairs
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(weights))), *map(pa.array, total.T.copy())],
                                         ["place", *[f"s{i}" for i in range(total.shape[1])]])

    return add


def leave_one_out_models(table: DataFrame, columns, fold: str = "video_id", tolerance: float = 1e-9,
                         steps: int = 60) -> DataFrame:
    """Weights on the plain features of the classifier of `fit_classifier`, for each clip trained on all others:
    fold, intercept, weights, and gradient, the largest entry of the mean loss's gradient that is left.

    All folds take their Newton steps together: one pass over the table gives every fold's loss, gradient and
    curvature, so the number of Spark jobs does not depend on the clips. What the driver holds is a few numbers per
    clip. Clips whose training rows have only one class are left out; rows without a clip train all models.
    """
    spark, columns = table.sparkSession, list(columns)
    d, k = len(columns), len(columns) + 1
    whole = table.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    kind = dict(table.dtypes)[fold]
    schema = f"`{fold}` {kind}, intercept double, weights array<double>, gradient double"
    if whole[0] is None:
        return spark.createDataFrame([], schema)
    middle, spread = np.array(whole[:d]), np.array([v if v > 0 else 1.0 for v in whole[d:]])
    rows = cut_lineage(table.select(F.col(fold).alias("_fold"), F.col("label").cast("int").alias("_label"), *[
        ((F.col(c) - F.lit(float(m))) / F.lit(float(v))).alias(f"_x{i}") for i, (c, m, v) in enumerate(zip(columns, middle, spread))]))
    x = [f"_x{i}" for i in range(d)]
    sums = rows.groupBy("_fold").agg(F.count("*"), F.sum("_label"), *[F.sum(c) for c in x], *[F.sum(F.col(c) ** 2) for c in x]).collect()
    held = np.array([r[1:] for r in sums], float)
    rest = held.sum(axis=0) - held                      # of the rows outside each clip
    good = [i for i, r in enumerate(sums) if r[0] is not None and 0 < rest[i, 1] < rest[i, 0]]
    if not good:
        return spark.createDataFrame([], schema)
    values, rest = [sums[i][0] for i in good], rest[good]
    places = {v: i for i, v in enumerate(values)}
    n, ones = rest[:, 0], rest[:, 1]
    class_weights = np.column_stack([n / (2 * (n - ones)), n / (2 * ones)])
    mean = rest[:, 2:2 + d] / n[:, None]
    variance = np.maximum(rest[:, 2 + d:] - n[:, None] * mean ** 2, 0) / np.maximum(n - 1, 1)[:, None]
    with np.errstate(divide="ignore"):
        scale = np.where(variance > 1e-18, 1 / np.sqrt(variance), 0.0)
    # from scaled weights (intercept first) to weights on the rows, for every fold
    turn = np.zeros((len(n), k, k))
    turn[:, 0, 0] = 1.0
    turn[:, 0, 1:] = -mean * scale
    turn[:, np.arange(1, k), np.arange(1, k)] = scale
    penalty = np.diag([0.0] + [1.0] * d)
    beta = best = np.zeros((len(n), k))
    move = np.zeros_like(beta)
    least, slope = np.full(len(n), np.inf), np.full(len(n), np.inf)
    names = [f"s{i}" for i in range(1 + k + k * k)]
    for _ in range(steps):
        raw = np.einsum("fij,fj->fi", turn, beta)
        made = rows.select("_fold", "_label", *x).mapInArrow(
            _fold_sums(d, places, raw, class_weights), "place long, " + ", ".join(f"{c} double" for c in names))
        found = sorted(tuple(r) for r in made.groupBy("place").agg(*[F.sum(c) for c in names]).collect())
        got = np.array([r[1:] for r in found])
        loss = got[:, 0] + (beta[:, 1:] ** 2).sum(axis=1) / 2
        gradient = np.einsum("fji,fj->fi", turn, got[:, 1:1 + k]) + beta @ penalty
        curve = np.einsum("fji,fjk,fkl->fil", turn, got[:, 1 + k:].reshape(-1, k, k), turn) + penalty
        better = loss <= least + 1e-12 * np.abs(least)
        best = np.where(better[:, None], beta, best)
        least = np.where(better, loss, least)
        slope = np.where(better, np.abs(gradient).max(axis=1) / n, slope)
        newton = -np.linalg.solve(curve + 1e-12 * np.eye(k), gradient[..., None])[..., 0]
        move = np.where(better[:, None], newton, move / 2)  # half the step where the last one went too far
        if (slope <= tolerance).all():
            break
        beta = np.where((slope > tolerance)[:, None], best + move, best)
    raw = np.einsum("fij,fj->fi", turn, best)
    weights = raw[:, 1:] / spread
    intercept = raw[:, 0] - weights @ middle
    return spark.createDataFrame([(v, float(b), w.tolist(), float(g)) for v, b, w, g in zip(values, intercept, weights, slope)], schema)


def leave_one_out_gradients(table: DataFrame, models: DataFrame, columns, fold: str = "video_id") -> DataFrame:
    """Largest entry of the gradient of each model's mean loss over the rows outside its clip, from the plain
    features by column expressions alone. A row meets the models of all other clips, a short list."""
    columns = list(columns)
    every = models.agg(F.collect_list(F.struct(F.col(fold).alias("clip"), "intercept", "weights")).alias("_models"))
    met = (table.join(F.broadcast(every), F.lit(True))  # one row
           .withColumn("_m", F.explode(F.filter("_models", lambda m: ~m["clip"].eqNullSafe(F.col(fold))))))
    margin = F.col("_m.intercept")
    for i, c in enumerate(columns):
        margin = margin + F.get("_m.weights", F.lit(i)) * F.col(c)
    rows = met.select(F.col("_m.clip").alias(fold), F.col("_m.weights").alias("_w"), "label", *columns,
                      (1 / (1 + F.exp(-margin)) - F.col("label")).alias("_r"))
    one = F.col("label") == 1

    def by_class(value):
        return [F.sum(F.when(one, value)), F.sum(F.when(~one, value))]

    aggs = [F.count("*").alias("_n"), F.sum("label").alias("_ones"), F.first("_w").alias("_w")]
    for i, c in enumerate(["", *columns]):
        value = F.col("_r") * F.col(c) if c else F.col("_r")
        aggs += [v.alias(f"_g{i}{k}") for k, v in enumerate(by_class(value))]
    for i, c in enumerate(columns):
        aggs += [F.avg(c).alias(f"_m{i}"), F.stddev_samp(c).alias(f"_s{i}")]
    sums = rows.groupBy(fold).agg(*aggs)
    n, ones = F.col("_n"), F.col("_ones")

    def weighted(i):
        return F.col(f"_g{i}0") * n / (2 * ones) + F.col(f"_g{i}1") * n / (2 * (n - ones))

    parts = [F.abs(weighted(0))]
    for i in range(len(columns)):
        s, w = F.col(f"_s{i}"), F.get("_w", F.lit(i))
        parts.append(F.when(s > 1e-9, F.abs((weighted(i + 1) - F.col(f"_m{i}") * weighted(0)) / s + w * s)).otherwise(F.lit(0.0)))
    return sums.select(fold, (F.greatest(*parts, F.lit(0.0)) / n).alias("gradient"))


def leave_one_out_scores(table: DataFrame, columns, fold: str = "video_id", out: str = "excavating_score") -> DataFrame:
    """Scores of each clip from a model trained on all other clips. Clips whose training rows
    have only one class are skipped. All rows are scored in one join with the models."""
    table = cut_lineage(table)
    models = leave_one_out_models(table, columns, fold).select(fold, F.col("intercept").alias("_b"), F.col("weights").alias("_w"))
    margin = F.col("_b")
    for i, c in enumerate(columns):
        margin = margin + F.get("_w", F.lit(i)) * F.col(c)
    return (table.join(models, fold)
            .withColumn(out, 1 / (1 + F.exp(-margin))).drop("_b", "_w"))


def fold_metrics(scores: DataFrame, fold=("video_id",), score: str = "excavating_score", label: str = "label",
                 threshold: float = 0.5) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall, F1 and ROC-AUC per fold. AUC is null for
    one class; its ranks come from distinct scores in blocks, so folds may be of any size."""
    fold = list(fold)
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    ranked = value_ranks(scores, fold, score, F.floor(F.col(score) * 1024), [F.count_if(pos).alias("n1")])
    ones, zeros = F.col("n1"), F.col("n") - F.col("n1")

    def total(rows, keep):
        return F.sum(F.when(keep, rows).otherwise(0))

    c = ranked.groupBy(*fold).agg(
        total(ones, hit).alias("tp"), total(zeros, hit).alias("fp"),
        total(ones, ~hit).alias("fn"), total(zeros, ~hit).alias("tn"),
        F.sum(ones * F.col("rank")).alias("rank_sum"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n1, n0 = tp + fn, tn + fp

    def share(a, b):
        return F.when(b > 0, a / b)

    recall, specificity = share(tp, n1), share(tn, n0)
    return c.select(
        *fold, (n1 + n0).alias("n_samples"), ((tp + tn) / (n1 + n0)).alias("accuracy"),
        F.coalesce((recall + specificity) / 2, recall, specificity).alias("balanced_accuracy"),
        F.coalesce(share(tp, tp + fp), F.lit(0.0)).alias("precision"), F.coalesce(recall, F.lit(0.0)).alias("recall"),
        F.coalesce(share(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        F.when((n1 > 0) & (n0 > 0), (F.col("rank_sum") - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("roc_auc"))


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Mean over folds; a fold without a metric does not count for it."""
    return metrics.agg(*[F.avg(m).alias(m) for m in METRICS])


def metric_gain(with_feature: DataFrame, without: DataFrame) -> DataFrame:
    """Difference of the fold means of two models, one row each."""
    a = mean_metrics(with_feature).select(*[F.col(m).alias(f"a_{m}") for m in METRICS])
    return a.join(F.broadcast(mean_metrics(without)), F.lit(True)).select(
        *[(F.col(f"a_{m}") - F.col(m)).alias(m) for m in METRICS])


def threshold_sweep(scores: DataFrame, score: str = "excavating_score", label: str = "label",
                    thresholds=THRESHOLDS) -> DataFrame:
    """Precision, recall, F1 and accuracy at each threshold: one pass, one row of counts."""
    pos = F.col(label) == 1
    counts = [F.struct(F.lit(t).alias("threshold"), F.count_if((F.col(score) >= t) & pos).alias("tp"),
                       F.count_if((F.col(score) >= t) & ~pos).alias("fp"),
                       F.count_if((F.col(score) < t) & pos).alias("fn"), F.count("*").alias("n")) for t in thresholds]
    c = scores.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def share(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)
    return c.select("threshold", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"),
                    share(2 * tp, 2 * tp + fp + fn).alias("f1"), ((F.col("n") - fp - fn) / F.col("n")).alias("accuracy"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Threshold with the largest F1, the lowest on ties."""
    row = F.struct("threshold", "precision", "recall", "f1")
    return sweep.agg(F.max_by(row, F.struct("f1", (-F.col("threshold")))).alias("b")).select("b.*")


def score_histogram(scores: DataFrame, score: str = "excavating_score") -> DataFrame:
    """Trajectories per score bin of 0.1, last bin closed."""
    s = F.col(score)
    return (scores.filter(s.between(0, 1)).groupBy(F.least(F.floor(s * 10), F.lit(9)).cast("int").alias("bin"))
            .agg(F.count("*").alias("n")))
