"""Detections against ground truth: overlap pairs, one-to-one matches, precision and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackframe.functions import geometry as g
from trackframe.functions.ordering import with_position
from trackframe.session import cut_lineage

IMAGE = ("video_id", "frame_number")
FOLD_PAIRS = 20_000  # overlap pairs of one image that one task may fold


def sequenced(boxes: DataFrame, image=IMAGE, extra=("is_gt",), order=None, block: Column | None = None,
              out: str = "seq") -> DataFrame:
    """Number the boxes of each image: most confident first, then by position."""
    order = order or [F.desc("confidence"), F.asc("px"), F.asc("py")]
    block = F.floor(-F.col("confidence") * 64) if block is None else block
    return with_position(boxes, [*image, *extra], order, block, out=out, rows_out="_n").drop("_n")


def _covered(boxes: DataFrame, image, cell: int) -> DataFrame:
    """One row per grid cell a box touches."""
    def span(low, high):
        return F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
    return boxes.withColumn("cell_x", span("box.x1", "box.x2")).withColumn("cell_y", span("box.y1", "box.y2"))


def overlap_pairs(gts: DataFrame, preds: DataFrame, image=IMAGE, threshold: float = 0.5,
                  cell: int = 64) -> DataFrame:
    """(image, g, p, confidence) of boxes that overlap by more than threshold.

    Boxes meet only in grid cells both touch; a pair is kept in the one cell that holds the
    corner of the intersection, so no distinct is needed.
    """
    image = list(image)
    whole = {c: g.truncated(c) for c in ("x1", "y1", "x2", "y2")}
    box = F.struct("x1", "y1", "x2", "y2").alias("box")
    left = _covered(gts.withColumns(whole).select(*image, F.col("seq").alias("g"), box), image, cell)
    right = _covered(preds.select(*image, F.col("seq").alias("p"), "confidence", box), image, cell)
    left, right = left.withColumnRenamed("box", "gbox"), right.withColumnRenamed("box", "pbox")
    home = ((F.floor(F.greatest("gbox.x1", "pbox.x1") / cell) == F.col("cell_x"))
            & (F.floor(F.greatest("gbox.y1", "pbox.y1") / cell) == F.col("cell_y")))
    return (left.join(right, [*image, "cell_x", "cell_y"])
            .filter(home & (g.overlap_ratio("gbox", "pbox") > threshold))
            .select(*image, "g", "p", "confidence"))


def _fold(pairs: Column) -> Column:
    """Go through pairs sorted by (g, p) and keep each whose both ends are still free."""
    start = F.struct(F.array().cast("array<bigint>").alias("g"), F.array().cast("array<bigint>").alias("p"))

    def step(acc, pair):
        taken = F.array_contains(acc["g"], pair["g"]) | F.array_contains(acc["p"], pair["p"])
        return F.when(taken, acc).otherwise(F.struct(
            F.array_append(acc["g"], pair["g"]).alias("g"), F.array_append(acc["p"], pair["p"]).alias("p")))
    return F.aggregate(pairs, start, step)


def _rounds(pairs: DataFrame, keys) -> DataFrame:
    """The same matches for images of any size, as joins.

    A pair that is the first one left at both of its boxes is what the ordered walk would
    take as well. Each round takes all of these at once and removes the pairs of taken boxes.
    """
    keys = list(keys)
    found = None
    left = pairs.select(*keys, "g", "p")
    while not left.isEmpty():
        by_g = left.groupBy(*keys, "g").agg(F.min("p").alias("p"))
        by_p = left.groupBy(*keys, "p").agg(F.min("g").alias("g"))
        taken = cut_lineage(by_g.join(by_p, [*keys, "g", "p"]).select(*keys, "g", "p"))
        found = taken if found is None else found.unionByName(taken)
        left = cut_lineage(left.join(taken.select(*keys, "g"), [*keys, "g"], "left_anti")
                           .join(taken.select(*keys, "p"), [*keys, "p"], "left_anti"))
    return found if found is not None else left


def greedy_matches(pairs: DataFrame, image=IMAGE, fold_pairs: int = FOLD_PAIRS) -> DataFrame:
    """One-to-one matches: ground truth in order, each takes its first free prediction.

    Images with up to fold_pairs pairs are folded inside one aggregate; larger ones are
    matched in join rounds with the same result.
    """
    image = list(image)
    pairs = cut_lineage(pairs.select(*image, "g", "p"))
    large = pairs.groupBy(*image).agg(F.count("*").alias("n")).filter(F.col("n") > fold_pairs).drop("n")
    none_large = large.isEmpty()
    small = pairs if none_large else pairs.join(large, image, "left_anti")
    lists = small.groupBy(*image).agg(F.sort_array(F.collect_list(F.struct("g", "p"))).alias("pairs"))
    folded = lists.select(*image, _fold(F.col("pairs")).alias("m")).select(
        *image, F.explode(F.arrays_zip("m.g", "m.p")).alias("z")).select(
        *image, F.col("z.g").alias("g"), F.col("z.p").alias("p"))
    if none_large:
        return folded
    return folded.unionByName(_rounds(pairs.join(large, image, "left_semi"), image))


def detection_counts(gts: DataFrame, preds: DataFrame, matches: DataFrame, by=("video_id",)) -> DataFrame:
    """True positives, false positives and misses per group, zeros included."""
    by = list(by)

    def tag(df, name):
        return df.select(*by, *[F.lit(int(n == name)).alias(n) for n in ("tp", "n_pred", "n_gt")])
    return (tag(gts, "n_gt").unionByName(tag(preds, "n_pred")).unionByName(tag(matches, "tp"))
            .groupBy(*by).agg(F.sum("tp").alias("tp"), (F.sum("n_pred") - F.sum("tp")).alias("fp"),
                              (F.sum("n_gt") - F.sum("tp")).alias("fn")))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def quality(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1; null where a denominator is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn),
                               "f1": _ratio(2 * tp, 2 * tp + fp + fn)})


def pooled_quality(counts: DataFrame) -> DataFrame:
    """Micro average: sums over all groups first."""
    return quality(counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def even_thresholds(preds: DataFrame, n: int = 50) -> list[float]:
    """n evenly spaced thresholds from the highest confidence down to 0."""
    top = preds.agg(F.max("confidence")).first()[0] or 0.0
    step = (0.0 - top) / (n - 1)
    return [top + i * step for i in range(n - 1)] + [0.0]


def _hits_per_step(lists: DataFrame, steps: Column) -> DataFrame:
    """step, tp of each image. A lower threshold keeps more pairs, so thresholds that keep equally many of an image
    keep the same and are folded once."""
    def n_kept(threshold):
        return F.size(F.filter("pairs", lambda e: e["confidence"] >= threshold))
    kept = F.transform(steps, lambda s: F.struct(s["step"].alias("step"), s["threshold"].alias("threshold"),
                                                 n_kept(s["threshold"]).alias("n")))
    each = lists.select("pairs", kept.alias("steps")).withColumn("n", F.explode(F.array_distinct("steps.n"))).filter("n > 0")
    same = each.select("pairs", F.filter("steps", lambda s: s["n"] == F.col("n")).alias("s"))
    pairs = F.filter("pairs", lambda e: e["confidence"] >= F.col("s.threshold")[0])
    return same.select("s.step", F.size(_fold(pairs)["g"]).alias("tp")).select(F.explode("step").alias("step"), "tp")


def precision_recall_curve(gts: DataFrame, preds: DataFrame, pairs: DataFrame, thresholds: list[float],
                           image=IMAGE, fold_pairs: int = FOLD_PAIRS) -> DataFrame:
    """Counts and quality per confidence threshold.

    The overlap pairs of an image are gathered once and folded again for each threshold that
    keeps other pairs than the one before; only one number per image and threshold leaves that task.
    """
    image = list(image)
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(t).alias("threshold"))
                      for i, t in enumerate(thresholds)])
    pairs = cut_lineage(pairs)
    large = pairs.groupBy(*image).agg(F.count("*").alias("n")).filter(F.col("n") > fold_pairs).drop("n")
    none_large = large.isEmpty()
    small = pairs if none_large else pairs.join(large, image, "left_anti")
    lists = small.groupBy(*image).agg(
        F.sort_array(F.collect_list(F.struct("g", "p", "confidence"))).alias("pairs"))
    hits = _hits_per_step(lists, steps)
    if not none_large:
        # every threshold is one copy of the image's pairs, matched in the same rounds
        more = (pairs.join(large, image, "left_semi").withColumn("s", F.explode(steps))
                .filter(F.col("confidence") >= F.col("s.threshold")).select(*image, "s.step", "g", "p"))
        hits = hits.unionByName(_rounds(more, [*image, "step"]).select("step", F.lit(1).alias("tp")))
    tp = hits.groupBy("step").agg(F.sum("tp").alias("tp"))
    above = [F.count_if(F.col("confidence") >= t) for t in thresholds]  # one pass, one row of counts
    n_pred = preds.agg(F.array(*above).alias("n")).select(F.posexplode("n").alias("step", "n_pred"))
    n_gt = gts.agg(F.count("*").alias("n_gt"))
    base = n_gt.withColumn("s", F.explode(steps)).select("n_gt", "s.*")
    out = base.join(tp, "step", "left").join(n_pred, "step", "left").fillna(0, subset=["tp", "n_pred"])
    return quality(out.select("step", "threshold", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"),
                              (F.col("n_gt") - F.col("tp")).alias("fn")))
