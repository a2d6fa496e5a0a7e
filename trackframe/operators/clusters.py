"""Clusters of trajectories, points and flux maps; sampling and audits of labels."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window, functions as F

from trackframe.functions import geometry as g
from trackframe.functions.ordering import first_row, last_row
from trackframe.functions.ratios import correlation
from trackframe.operators.kinematics import centred, order_of
from trackframe.operators.resampling import hash_text
from trackframe.session import cut_lineage

# Feature names and the pairs of clusters that are reported as one.
FEATURES = ("efficiency", "straight_distance", "avg_angle_change", "total_length")
COMBINED = {3: 0, 2: 1}


# ---- distribution of labels over time ---------------------------------------------------

def cluster_shares(trajectories: DataFrame, by=("day", "hour"), label: str = "cluster_label") -> DataFrame:
    """Share of each label among the trajectories of a slot. The total is taken over the few
    label rows of a slot, after counting."""
    n = trajectories.groupBy(*by, label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return n.withColumn("fraction", F.col("n") / total)


def share_statistics(shares: DataFrame, by, label: str = "cluster_label") -> DataFrame:
    return shares.groupBy(*by, label).agg(F.avg("fraction").alias("fraction"))


def hour_by_cluster(shares: DataFrame, labels, label: str = "cluster_label") -> DataFrame:
    """Mean share per hour with one column per label, 0 where a label never occurs."""
    p = shares.groupBy("hour").pivot(label, list(labels)).agg(F.avg("fraction"))
    return p.select("hour", *[F.coalesce(F.col(str(v)), F.lit(0.0)).alias(f"cluster_{v}") for v in labels])


def peak_hours(shares: DataFrame, label: str = "cluster_label") -> DataFrame:
    """Hour with the largest mean share of each label, the earliest on ties."""
    mean = share_statistics(shares, ["hour"], label)
    best = F.max_by(F.struct("hour", "fraction"), F.struct(F.round("fraction", 12), (-F.col("hour"))))
    return mean.groupBy(label).agg(best.alias("b")).select(
        label, F.col("b.hour").alias("peak_hour"), F.col("b.fraction").alias("peak_fraction"))


def feature_summary(trajectories: DataFrame, by, features=FEATURES) -> DataFrame:
    """Mean and sample deviation of each feature per group."""
    aggs = [f(c).alias(f"{c}_{n}") for c in features for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return trajectories.groupBy(*by).agg(F.count("*").alias("n"), *aggs)


def features_per_hour(trajectories: DataFrame, label: str = "cluster_label", features=FEATURES) -> DataFrame:
    """The same per label and hour, and per label over all hours (null hour), in one pass."""
    aggs = [f(c).alias(f"{c}_{n}") for c in features for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return (trajectories.rollup(label, "hour").agg(F.count("*").alias("n"), *aggs, F.grouping_id().alias("_g"))
            .filter(F.col("_g") < 3).drop("_g"))


def features_at_peak(trajectories: DataFrame, peaks: DataFrame, label: str = "cluster_label",
                     features=FEATURES) -> DataFrame:
    rows = trajectories.join(peaks.select(label, F.col("peak_hour").alias("hour")), [label, "hour"])
    return feature_summary(rows, [label, "hour"], features)


def label_audit(trajectories: DataFrame, label: str = "cluster_label", index: str = "trajectory_index") -> DataFrame:
    """One row of violation counts over labels and running index."""
    v = F.col(label)
    per_label = trajectories.groupBy(label).agg(F.count("*").alias("n"))
    labels = per_label.agg(
        F.count_if(v != F.floor(v)).alias("non_integer_labels"),
        F.count_if((v < 0) & (v != -1)).alias("negative_labels"),
        (F.max(F.when(v >= 0, v)) + 1 - F.count_if(v >= 0)).cast("bigint").alias("gaps"),
        F.when(F.count_if(v == 0) == 0, 1).otherwise(0).alias("zero_missing"),
        F.sum(F.when(v.isNull(), F.col("n")).otherwise(0)).alias("null_labels"))
    copies = trajectories.groupBy(index).agg(F.count("*").alias("n"))
    order = copies.agg(
        F.sum(F.col("n") - 1).alias("duplicate_indices"),
        F.when((F.min(index) == 0) & (F.max(index) == F.sum("n") - 1), 0).otherwise(1).alias("index_incomplete"))
    return labels.join(F.broadcast(order), F.lit(True))  # one row each


def label_sizes(trajectories: DataFrame, label: str = "cluster_label") -> DataFrame:
    n = trajectories.groupBy(label).agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def _long(df: DataFrame, features) -> DataFrame:
    """One row per feature value; the expanded rows are combined before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def feature_quality(trajectories: DataFrame, features=FEATURES) -> DataFrame:
    """Mean, deviation and range of each feature with flags for constant, narrow and good ones."""
    s = _long(trajectories, features).groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("lowest"), F.max("value").alias("highest"))
    width = F.col("highest") - F.col("lowest")
    return s.withColumns({"is_constant": F.col("std") < 1e-6, "small_range": width < 0.1,
                          "low_variance": F.col("std") < 0.1, "is_good": (F.col("std") > 0.1) & (width > 0.1)})


def feature_correlations(trajectories: DataFrame, features=FEATURES, k: int | None = 5) -> DataFrame:
    """Absolute correlation of feature pairs, the k strongest."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    one = trajectories.agg(F.array(*[F.struct(
        F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), correlation(a, b).alias("r")) for a, b in pairs]).alias("p"))
    out = one.select(F.explode("p").alias("p")).select("p.*").withColumn("strength", F.abs("r"))
    return out if k is None else out.orderBy(F.desc_nulls_last("strength"), "feature_a", "feature_b").limit(k)


def most_variable(trajectories: DataFrame, features, k: int = 10) -> DataFrame:
    v = _long(trajectories, features).groupBy("feature").agg(F.var_pop("value").alias("variance"))
    return v.orderBy(F.desc("variance"), "feature").limit(k)


# ---- samples ----------------------------------------------------------------------------

def sample_per_cluster(trajectories: DataFrame, n: int, label: str = "cluster_label",
                       ids=("video_id", "ant_id"), seed: int = 42) -> DataFrame:
    """n random trajectories of each label. The filter on the row number is applied inside
    each partition first, so only n rows per label and partition are shuffled."""
    order = hash_text(F.lit(seed), *[F.col(c) for c in ids])
    w = Window.partitionBy(label).orderBy("_h", *ids)
    return (trajectories.withColumn("_h", order).withColumn("_k", F.row_number().over(w))
            .filter(F.col("_k") <= n).drop("_h", "_k"))


def representative_sample(trajectories: DataFrame, n: int, length: str = "trajectory_length",
                          ids=("video_id", "ant_id")) -> DataFrame:
    """The same number of trajectories from each length quartile, first ids first; all of them
    when there are at most n. Lengths are combined before the quartiles are taken."""
    tally = trajectories.groupBy(length).agg(F.count("*").alias("_n"))
    cut = tally.agg(F.percentile(length, F.array(F.lit(.25), F.lit(.5), F.lit(.75)), F.col("_n")).alias("_q"),
                    F.sum("_n").alias("_all"))
    t = trajectories.join(F.broadcast(cut), F.lit(True))  # one row
    x, q = F.col(length), F.col("_q")
    quartile = F.when(x <= q[0], 0).when(x <= q[1], 1).when(x <= q[2], 2).otherwise(3)
    w = Window.partitionBy("quartile").orderBy(*ids)
    ranked = t.withColumn("quartile", quartile).withColumn("_k", F.row_number().over(w))
    # at most n rows of a quartile are ever taken, so each task cuts its own rows before the shuffle
    first = ranked.filter(F.col("_k") <= n)
    return first.filter((F.col("_k") <= n // 4) | (F.col("_all") <= n)).drop("_q", "_all", "_k")


def assembled(df: DataFrame, features, scaled: bool = True) -> DataFrame:
    """Rows with all features as vector `features`; scaled to mean 0 and deviation 1. The
    feature table (one row per trajectory) is written once, as fitting reads it many times;
    nulls are dropped from what was written, so the planner meets plain columns."""
    whole = cut_lineage(df).dropna(subset=list(features))
    out = VectorAssembler(inputCols=list(features), outputCol="raw").transform(whole)
    if not scaled:
        return out.withColumnRenamed("raw", "features")
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(out).transform(out).drop("raw")


def _nearest_to_centre(model: KMeansModel, rows: DataFrame, ids) -> DataFrame:
    centres = model.clusterCenters()
    labelled = model.transform(rows).withColumn("_v", vector_to_array("features"))
    points = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    centre = F.get(points, F.col("prediction"))
    d = F.aggregate(F.zip_with("_v", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    row = F.struct(*ids)
    return labelled.withColumn("_d", d).groupBy("prediction").agg(
        F.min_by(row, F.struct("_d", *ids)).alias("r")).select("prediction", "r.*")


def diverse_sample(trajectories: DataFrame, n: int, ids=("video_id", "ant_id"),
                   features=("total_length", "efficiency"), seed: int = 42) -> DataFrame:
    """One trajectory per cluster of (length, efficiency): the one nearest to the centre."""
    rows = assembled(trajectories, features, scaled=False)
    model = KMeans(k=n, seed=seed, featuresCol="features").fit(rows)
    return _nearest_to_centre(model, rows, list(ids))


# ---- behaviour clusters -----------------------------------------------------------------

def elbow(costs: list[float], first_k: int = 2) -> int:
    """Number of clusters one past the largest second difference of at least three costs."""
    if len(costs) < 3:
        raise ValueError("the elbow needs costs of three numbers of clusters, so at least 10 rows")
    second = [costs[i] - 2 * costs[i + 1] + costs[i + 2] for i in range(len(costs) - 2)]
    at = max(range(len(second)), key=second.__getitem__) + 2
    return first_k + at


def behaviour_clusters(trajectories: DataFrame, n_clusters: int | None = None, features=FEATURES,
                       seed: int = 42) -> tuple[DataFrame, KMeansModel]:
    """K-means labels of standardised features; the number by the elbow of k from 2 to 10, or to
    one below half the rows where that is less. Fewer than 10 rows need n_clusters."""
    rows = assembled(trajectories, features)
    if n_clusters is None:
        top = min(11, rows.count() // 2)
        costs = [KMeans(k=k, seed=seed).fit(rows).summary.trainingCost for k in range(2, top)]
        n_clusters = elbow(costs)
    model = KMeans(k=n_clusters, seed=seed).fit(rows)
    return model.transform(rows).withColumnRenamed("prediction", "cluster_label"), model


def cluster_quality(labelled: DataFrame, features_col: str = "features", label: str = "cluster_label") -> DataFrame:
    """Clusters, noise share, silhouette (squared distances) and Calinski-Harabasz score."""
    spark = labelled.sparkSession
    sil = ClusteringEvaluator(featuresCol=features_col, predictionCol=label).evaluate(labelled)
    d = labelled.select(label, vector_to_array(features_col).alias("v"))
    long = d.select(label, F.posexplode("v").alias("dim", "x"))
    per = long.groupBy(label, "dim").agg(F.count("*").alias("n"), F.avg("x").alias("m"),
                                         F.var_pop("x").alias("s"))
    all_ = long.groupBy("dim").agg(F.avg("x").alias("m0"))
    sums = per.join(all_, "dim").agg(
        F.sum(F.col("n") * F.col("s")).alias("within"),
        F.sum(F.col("n") * (F.col("m") - F.col("m0")) ** 2).alias("between"))
    counts = labelled.agg(F.count_distinct(F.when(F.col(label) >= 0, F.col(label))).alias("n_clusters"),
                          F.count("*").alias("n"), F.avg((F.col(label) < 0).cast("double")).alias("noise_ratio"))
    k, n = F.col("n_clusters"), F.col("n")
    out = counts.join(F.broadcast(sums), F.lit(True))
    return out.select("n_clusters", "n", "noise_ratio", F.lit(float(sil)).alias("silhouette"),
                      F.try_divide(F.col("between") * (n - k), F.col("within") * (k - 1)).alias("calinski_harabasz"))


def principal_components(rows: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """Centred principal components of vector column `features`, with their variance shares."""
    rows = cut_lineage(rows)
    centred = StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="centred", outputCol="pca").fit(centred)
    return model.transform(centred).drop("centred"), [float(v) for v in model.explainedVariance]


def component_checks(rows: DataFrame, k: int) -> DataFrame:
    """What must hold for principal components `pca` of vectors `features`: per component the number of rows, its
    variance, the length of its direction and the largest product of its direction with another's.

    A direction is read off the scores, as covariance of features and score over the variance of the score. For a
    unit vector v that gives A v / (v'A v), which has length 1 only where v is an eigenvector of the covariance A.
    """
    v = rows.select(vector_to_array("features").alias("v"), vector_to_array("pca").alias("p"))
    long = v.select("p", F.posexplode("v").alias("dim", "x"))
    score = [F.col("p")[i] for i in range(k)]
    one = long.groupBy("dim").agg(F.count("*").alias("n"), F.array(*[F.covar_samp("x", c) for c in score]).alias("c"),
                                  F.array(*[F.var_samp(c) for c in score]).alias("e"))
    w = [F.col("c")[i] / F.col("e")[i] for i in range(k)]
    products = F.array(*[F.array(*[F.sum(a * b) for b in w]) for a in w])
    grams = one.agg(F.max("n").alias("n"), F.first("e").alias("e"), products.alias("g"))
    i = F.col("i")
    others = F.transform("row", lambda x, j: F.when(j == i, 0.0).otherwise(F.abs(x)))
    return grams.select("n", "e", F.posexplode("g").alias("i", "row")).select(
        (i + 1).alias("component"), "n", F.get("e", i).alias("variance"), F.sqrt(F.get("row", i)).alias("length"),
        F.array_max(others).alias("largest_product"))


def leading_components(rows: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """The same for long vectors: singular vectors of the centred rows by products with them, so that no matrix of
    features x features is made. What the driver holds is k vectors. Fewer than k where the rows span fewer."""
    rows = cut_lineage(rows)
    scaler = StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False).fit(rows)
    centred = cut_lineage(scaler.transform(rows))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(centred.select("centred"), "centred")).computeSVD(k)
    loadings = rows.sparkSession.createDataFrame([(svd.V.toArray().T.tolist(),)], "loadings array<array<double>>")

    def product(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    held = centred.withColumn("_v", vector_to_array("centred"))
    total = held.agg(F.sum(product(F.col("_v"), F.col("_v")))).first()[0]
    pca = array_to_vector(F.transform("loadings", lambda c: product(F.col("_v"), c)))
    out = held.join(F.broadcast(loadings), F.lit(True)).withColumn("pca", pca).drop("_v", "centred", "loadings")  # one row
    return out, [float(v) ** 2 / total for v in svd.s]


def flux_map_vectors(shares: DataFrame, by=("site_id", "day", "hour"), nx: int = 96, ny: int = 54,
                     value: str = "share") -> DataFrame:
    """Dense vector of each flux map in row order; a map has nx * ny entries at most."""
    cells = shares.groupBy(*by).agg(F.sort_array(F.collect_list(
        F.struct((F.col("y_bin") * nx + F.col("x_bin")).cast("int").alias("at"), F.col(value).alias("v")))).alias("m"))
    # zeros up to each entry, the entry, and zeros up to the end
    before = F.transform("m", lambda e, i: F.concat(
        F.array_repeat(F.lit(0.0), e["at"] - F.when(i > 0, F.get(F.col("m"), i - 1)["at"]).otherwise(F.lit(-1)) - 1), F.array(e["v"])))
    dense = F.concat(F.flatten(before), F.array_repeat(F.lit(0.0), nx * ny - 1 - F.element_at("m", -1)["at"]))
    return cells.select(*by, array_to_vector(dense).alias("features"))


def flux_map_clusters(vectors: DataFrame, n_components: int = 20, n_clusters: int = 6,
                      seed: int = 0) -> tuple[DataFrame, list[float]]:
    """Principal components of flux maps, then k-means."""
    rows, shares = leading_components(vectors, n_components)
    rows = cut_lineage(rows.drop("features"))
    model = KMeans(k=n_clusters, seed=seed, featuresCol="pca").fit(rows)
    return model.transform(rows).withColumnRenamed("prediction", "cluster_label"), shares


# ---- density clusters -------------------------------------------------------------------

def connected_components(nodes: DataFrame, edges: DataFrame, group) -> DataFrame:
    """Smallest node id reachable from each node (group, node) over edges (group, a, b).

    Every round takes the smallest label of the neighbours and then the label of that label,
    so long chains halve; each round is written before the next.
    """
    group = list(group)
    both = cut_lineage(edges.select(*group, "a", "b").unionByName(
        edges.select(*group, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut_lineage(nodes.select(*group, "node", F.col("node").alias("label")))
    changed = True
    while changed:
        near = (both.join(state.select(*group, F.col("node").alias("b"), "label"), [*group, "b"])
                .groupBy(*group, F.col("a").alias("node")).agg(F.min("label").alias("near")))
        step = cut_lineage(state.join(near, [*group, "node"], "left").select(
            *group, "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")))
        hop = step.select(*group, F.col("node").alias("label"), F.col("label").alias("up"))
        state = cut_lineage(step.join(hop, [*group, "label"]).select(*group, "node", "old", F.col("up").alias("label")))
        changed = not state.filter(F.col("label") != F.col("old")).isEmpty()
        state = state.drop("old")
    return state


def _cells_around(reach: int = 2) -> list[tuple[int, int]]:
    span = range(-reach, reach + 1)
    return [(i, j) for i in span for j in span]


def density_clusters(points: DataFrame, group, x: str, y: str, eps: float, min_samples: int) -> DataFrame:
    """DBSCAN labels 0, 1, ... per group, -1 for noise; border points join the lowest label.

    Points are combined by position and put in cells of side eps / sqrt(2), whose points are
    all within eps of each other. A cell with min_samples points needs no distances at all;
    for the others only positions in nearby cells are compared. Clusters are connected
    components of cells, joined where outermost core positions come within eps.
    """
    group = list(group)
    side = eps / math.sqrt(2)
    gx, gy = F.floor(F.col("px") / side), F.floor(F.col("py") / side)
    pos = cut_lineage(
        points.groupBy(*group, F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
        .agg(F.count("*").alias("n")).withColumns({"gx": gx, "gy": gy}))
    cell = [*group, "gx", "gy"]
    total = pos.groupBy(*cell).agg(F.sum("n").alias("cell_n"))
    sized = pos.join(total, cell)
    near_cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _cells_around()])

    def around(df, keep):
        return df.withColumn("_o", F.explode(near_cells)).select(
            *group, *keep, (F.col("gx") + F.col("_o.i")).alias("gx"), (F.col("gy") + F.col("_o.j")).alias("gy"),
            (F.struct(F.col("_o.i"), F.col("_o.j"))).alias("_o"))

    sparse = sized.filter(F.col("cell_n") < min_samples)
    a = around(sparse.select(*group, "gx", "gy", F.col("px").alias("ax"), F.col("py").alias("ay")), ["ax", "ay"])
    enough = (a.join(pos, cell).filter(g.distance("ax", "ay", "px", "py") <= eps)
              .groupBy(*group, F.col("ax").alias("px"), F.col("ay").alias("py"))
              .agg(F.sum("n").alias("reach")).filter(F.col("reach") >= min_samples).drop("reach"))
    core = cut_lineage(
        sized.filter(F.col("cell_n") >= min_samples).select(*group, "px", "py", "gx", "gy")
        .unionByName(sparse.join(enough, [*group, "px", "py"], "left_semi").select(*group, "px", "py", "gx", "gy")))
    # outermost core positions of each cell: the ends of its rows and columns
    rows = core.groupBy(*cell, "py").agg(F.array(F.min("px"), F.max("px")).alias("e")).select(
        *cell, F.explode("e").alias("px"), "py")
    cols = core.groupBy(*cell, "px").agg(F.array(F.min("py"), F.max("py")).alias("e")).select(
        *cell, "px", F.explode("e").alias("py"))
    rim = rows.unionByName(cols).distinct()
    node = (F.col("gx") + 2 ** 30) * 2 ** 31 + (F.col("gy") + 2 ** 30)
    ahead = around(rim.withColumn("a", node).withColumnsRenamed({"px": "ax", "py": "ay"}), ["a", "ax", "ay"]).filter(
        F.col("_o") > F.struct(F.lit(0), F.lit(0)))
    edges = (ahead.join(rim.withColumn("b", node), cell).filter(g.distance("ax", "ay", "px", "py") <= eps)
             .select(*group, "a", "b").distinct())
    nodes = core.select(*group, node.alias("node")).distinct()
    parts = connected_components(nodes, edges, group)
    named = core.withColumn("node", node).join(parts, [*group, "node"])
    first = named.groupBy(*group, "label").agg(F.min(F.struct("px", "py")).alias("first"))
    order = first.withColumn("cluster", F.row_number().over(Window.partitionBy(*group).orderBy("first")) - 1)
    labelled = cut_lineage(named.join(order.select(*group, "label", "cluster"), [*group, "label"])
                           .select(*group, "px", "py", "gx", "gy", "cluster"))
    rest = pos.join(labelled, [*group, "px", "py"], "left_anti")
    b = around(rest.select(*group, "gx", "gy", F.col("px").alias("ax"), F.col("py").alias("ay")), ["ax", "ay"])
    border = (b.join(labelled, cell).filter(g.distance("ax", "ay", "px", "py") <= eps)
              .groupBy(*group, F.col("ax").alias("px"), F.col("ay").alias("py")).agg(F.min("cluster").alias("cluster")))
    known = labelled.select(*group, "px", "py", "cluster").unionByName(border)
    return (points.withColumns({"px": F.col(x).cast("double"), "py": F.col(y).cast("double")})
            .join(known, [*group, "px", "py"], "left")
            .withColumn("cluster", F.coalesce("cluster", F.lit(-1))).drop("px", "py"))


def trajectory_ends(tracks: DataFrame, keys, min_rows: int = 5) -> DataFrame:
    """First and last position and length of each trajectory."""
    t = centred(tracks)
    here, order = ("center_x", "center_y"), order_of(t)
    e = t.groupBy(*keys).agg(first_row(here, order).alias("s"), last_row(here, order).alias("e"),
                             F.count("*").alias("n_rows")).filter(F.col("n_rows") >= min_rows)
    return e.select(*keys, "n_rows", F.col("s.center_x").alias("start_x"), F.col("s.center_y").alias("start_y"),
                    F.col("e.center_x").alias("end_x"), F.col("e.center_y").alias("end_y"))


def end_to_end_trails(ends: DataFrame, group, eps: float = 50.0, min_samples: int = 3,
                      min_trajectories: int = 3, min_length: float = 100.0) -> DataFrame:
    """Trails as pairs of a start cluster and an end cluster with enough, long enough
    trajectories; mean start, end and direction of each."""
    group = list(group)
    s = density_clusters(ends, group, "start_x", "start_y", eps, min_samples).withColumnRenamed("cluster", "start_cluster")
    b = density_clusters(s, group, "end_x", "end_y", eps, min_samples).withColumnRenamed("cluster", "end_cluster")
    t = (b.filter((F.col("start_cluster") >= 0) & (F.col("end_cluster") >= 0))
         .groupBy(*group, "start_cluster", "end_cluster")
         .agg(F.count("*").alias("n_trajectories"), F.avg("n_rows").alias("mean_length"),
              *[F.avg(c).alias(c) for c in ("start_x", "start_y", "end_x", "end_y")]))
    return t.filter((F.col("n_trajectories") >= min_trajectories) & (F.col("mean_length") >= min_length)).withColumns(
        {"direction_x": F.col("end_x") - F.col("start_x"), "direction_y": F.col("end_y") - F.col("start_y")})
