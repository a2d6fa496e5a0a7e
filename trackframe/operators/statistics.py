"""Tests, correlations and regression on slot-level tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from trackframe.session import cut_lineage
from trackframe.functions.ordering import ranks_in_small_groups, value_ranks
from trackframe.functions.names import cyclic_hour
from trackframe.functions.ratios import correlation


def two_sample_t(values: DataFrame, group, a: str = "away", b: str = "toward") -> DataFrame:
    """Pooled-variance t statistic of two columns per group."""
    na, nb = F.count(a), F.count(b)
    s = values.groupBy(*group).agg(
        na.alias("na"), nb.alias("nb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"),
        F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    df = F.col("na") + F.col("nb") - 2
    spread = (F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")
    pooled = F.try_divide(spread, df)
    se = F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("na")) + F.try_divide(F.lit(1.0), F.col("nb"))))
    return s.select(*group, (F.col("na") + F.col("nb") - 2).alias("dof"),
                    F.when(se > 0, (F.col("ma") - F.col("mb")) / se).alias("t"))


def _rank_sums(values: DataFrame, group, a: str, b: str, block: Column | None) -> DataFrame:
    """Sizes na and nb of both columns, rank sum ra of the first, and the sum of ties cubed less ties."""
    long = values.select(*group, F.explode(F.array(
        F.struct(F.lit(1).alias("is_a"), F.col(a).alias("x")),
        F.struct(F.lit(0).alias("is_a"), F.col(b).alias("x")))).alias("s")).select(*group, "s.*")
    long = long.filter(F.col("x").isNotNull())
    ranked = value_ranks(long, group, "x", block, [F.sum("is_a").alias("in_a")])
    ties = F.col("n").cast("double")
    return ranked.groupBy(*group).agg(
        F.sum("in_a").cast("double").alias("na"), F.sum(F.col("n") - F.col("in_a")).cast("double").alias("nb"),
        F.sum(F.col("in_a") * F.col("rank")).alias("ra"), F.sum(ties ** 3 - ties).alias("ties"))


def mann_whitney_u(values: DataFrame, group, a: str = "away", b: str = "toward",
                   block: Column | None = None) -> DataFrame:
    """U of the first column from average ranks, with the tie-corrected normal score."""
    group = list(group)
    s = _rank_sums(values, group, a, b, block)
    na, nb = F.col("na"), F.col("nb")
    n = na + nb
    u = F.col("ra") - na * (na + 1) / 2
    var = na * nb / 12 * (n + 1 - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0)))
    z = F.when(var > 0, (F.abs(u - na * nb / 2) - 0.5) / F.sqrt(var))
    return s.select(*group, u.alias("u"), z.alias("z"))


def exact_u_p_value(u: Column, na: Column, nb: Column) -> Column:
    """Two-sided p-value of U among all orders of na and nb values without ties.

    The number of orders with each U is a coefficient of the product of (1 - q^(nb + i)) / (1 - q^i) for i up to
    na; one factor is multiplied in by a difference and divided out by a running sum. For small na and nb, whose
    product bounds the array.
    """
    size = (na * nb).cast("int") + 1
    one = F.array_append(F.array().cast("array<double>"), F.lit(1.0))
    start = F.concat(one, F.array_repeat(F.lit(0.0), size - 1))

    def factor(p, i):
        shift = nb.cast("int") + i
        less = F.transform(p, lambda v, k: v - F.when(k >= shift, F.get(p, k - shift)).otherwise(0.0))
        return F.aggregate(less, F.array().cast("array<double>"), lambda done, v: F.array_append(
            done, v + F.when(F.size(done) >= i, F.get(done, F.size(done) - i)).otherwise(0.0)))

    ways = F.when((na > 0) & (nb > 0), F.aggregate(F.sequence(F.lit(1), F.greatest(na.cast("int"), F.lit(1))), start, factor))
    far = F.greatest(u, na * nb - u).cast("int")
    tail = F.aggregate(F.slice(ways, far + 1, size), F.lit(0.0), lambda t, v: t + v)
    return F.least(F.lit(1.0), 2 * tail / F.aggregate(ways, F.lit(0.0), lambda t, v: t + v))


def mann_whitney_test(values: DataFrame, group, a: str = "away", b: str = "toward", block: Column | None = None,
                      exact: int = 8) -> DataFrame:
    """U and its two-sided p-value: exact where neither column has more than `exact` values and none are tied,
    else by the tie-corrected normal score."""
    group = list(group)
    values = cut_lineage(values.select(*group, a, b))
    s = _rank_sums(values, group, a, b, block)
    small = (F.col("ties") == 0) & (F.greatest("na", "nb") <= exact) & (F.least("na", "nb") > 0)
    u = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2
    # arrays are made from sizes within the bound only
    na, nb = (F.when(small, F.col(c)) for c in ("na", "nb"))
    few = s.select(*group, F.when(small, exact_u_p_value(u, na, nb)).alias("_exact"))
    return mann_whitney_u(values, group, a, b, block).join(few, group).select(
        *group, "u", F.coalesce("_exact", normal_p_value(F.col("z"))).alias("p_value"))


def lagged_correlations(series: DataFrame, group, max_lag: int = 12, min_samples: int = 5,
                        leader: str = "toward", follower: str = "away", t: str = "t") -> DataFrame:
    """Pearson r between leader(t) and follower(t + lag) for each lag; null with too few
    samples or a constant series. Rows are sent to t + lag, so this is an equi-join."""
    group = list(group)
    lead = series.select(*group, F.col(leader).alias("x"), F.col(t).alias("_t"),
                         F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"))
    lead = lead.withColumn(t, F.col("_t") + F.col("lag")).drop("_t")
    pairs = lead.join(series.select(*group, t, F.col(follower).alias("y")), [*group, t])
    s = pairs.groupBy(*group, "lag").agg(
        F.count("*").alias("n"), correlation("x", "y").alias("r"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    ok = (F.col("n") >= min_samples) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    r = F.when(ok, F.col("r"))
    tstat = r * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), 1 - r * r))
    return s.select(*group, "lag", "n", r.alias("r"), tstat.alias("t_stat"))


def best_lags(correlations: DataFrame, group) -> DataFrame:
    """Lag of the strongest correlation, the smallest lag on ties; lag 0 and null if none."""
    size = F.round(F.abs(F.col("r")), 12)
    best = F.max_by(F.struct("lag", "r", "n", "t_stat"), F.when(
        F.col("r").isNotNull(), F.struct(size, (-F.col("lag")))))
    return correlations.groupBy(*group).agg(best.alias("b")).select(
        *group, F.coalesce("b.lag", F.lit(0)).alias("best_lag"), F.col("b.r").alias("best_r"),
        F.col("b.n").alias("n"), F.col("b.t_stat").alias("t_stat"))


def lag_summary(best: DataFrame, alpha: float = 0.05) -> DataFrame:
    p = student_p_value(F.col("t_stat"), (F.col("n") - 2).cast("double"))
    return best.withColumn("p_value", p).agg(
        F.avg("best_r").alias("mean_best_r"), F.avg("best_lag").alias("mean_best_lag"),
        F.count_if(F.col("p_value") < alpha).alias("n_significant"), F.count("*").alias("n_trails"))


def spearman(pairs: DataFrame, group, x: str, y: str) -> DataFrame:
    """Rank correlation per group (small groups: the hours of a day); null if one side is constant."""
    group = list(group)
    ranked = pairs.select(*group, ranks_in_small_groups(group, x).alias("rx"),
                          ranks_in_small_groups(group, y).alias("ry"))
    return ranked.groupBy(*group).agg(
        F.when((F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry")), correlation("rx", "ry")).alias("rho"))


def sign_agreement(pairs: DataFrame, group, x: str, y: str) -> DataFrame:
    """Share of rows where both values have the same sign; two zeros agree."""
    same = (F.signum(x) == F.signum(y)).cast("double")
    return pairs.groupBy(*group).agg(F.avg(same).alias("agreement"))


def on_hours(days: DataFrame, values: DataFrame, keys=("site_id", "day"), columns=()) -> DataFrame:
    """All 24 hours of each day, with 0 for the missing ones."""
    spine = days.select(*keys).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return spine.join(values, [*keys, "hour"], "left").fillna(0.0, subset=list(columns))


def _summed(first: Column, ratio, count: Column) -> Column:
    """first + first * ratio(1) + first * ratio(1) * ratio(2) + ..., count terms in all."""
    start = F.struct(first.alias("term"), first.alias("sum"))

    def more(acc, k):
        term = acc["term"] * ratio(k)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))
    terms = F.when(count > 1, F.sequence(F.lit(1), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(count > 0, F.aggregate(terms, start, more, lambda acc: acc["sum"])).otherwise(0.0)


def student_p_value(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom, as the finite sum it then is; one
    term for every two degrees. Null without t or below one degree."""
    dof = dof.cast("double")
    sine, cosine2 = F.abs(t) / F.sqrt(dof + t * t), dof / (dof + t * t)
    count = F.floor(dof / 2)
    even = sine * _summed(F.lit(1.0), lambda k: cosine2 * (2 * k - 1) / (2 * k), count)
    odd = (F.atan(F.abs(t) / F.sqrt(dof)) + sine * _summed(F.sqrt(cosine2), lambda k: cosine2 * (2 * k) / (2 * k + 1), count)) * (
        2 / math.pi)
    return F.when(dof >= 1, F.greatest(F.lit(0.0), 1.0 - F.when(dof % 2 == 0, even).otherwise(odd)))


def normal_p_value(z: Column) -> Column:
    """Two-sided p-value of a normal score, 1 for scores that a continuity correction made negative. The
    error function is summed from positive terms; beyond 9 the value is below 1e-18 and 0 is returned."""
    x = z / math.sqrt(2)
    inside = F.exp(-x * x) * (2 / math.sqrt(math.pi)) * _summed(x, lambda k: 2 * x * x / (2 * k + 1), F.lit(160))
    return F.when(z <= 0, 1.0).when(z > 9, 0.0).when(z.isNotNull(), F.greatest(F.lit(0.0), 1.0 - inside))


PREDICTORS = ("hour_sin", "hour_cos", "temperature", "humidity", "lux")


def regression_table(clips: DataFrame, response: str) -> DataFrame:
    """Log response with cyclic hour and environment. Rows with a response <= 0 have no
    logarithm and are left out; count them with `clips.filter(response <= 0)`."""
    return (clips.filter(F.col(response) > 0)
            .select("site_id", "day", "hour", F.ln(response).alias("y"), *cyclic_hour(F.col("hour")),
                    "temperature", "humidity", "lux"))


def standardised(df: DataFrame, columns, ddof_sample: bool = True) -> DataFrame:
    """Columns minus mean over deviation; the 1-row summary is broadcast by its fixed size."""
    std = F.stddev_samp if ddof_sample else F.stddev_pop
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[std(c).alias(f"s_{c}") for c in columns])
    out = df.join(F.broadcast(stats), F.lit(True))
    return out.withColumns({c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)
                            for c in columns}).drop(*[f"m_{c}" for c in columns], *[f"s_{c}" for c in columns])


def predictor_correlations(table: DataFrame, predictors=PREDICTORS) -> DataFrame:
    """Correlation of every two predictors."""
    pairs = [(a, b) for a in predictors for b in predictors]
    one = table.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(a, b).alias("r"))
                              for a, b in pairs]).alias("p"))
    return one.select(F.explode("p").alias("p")).select("p.*")


def variance_inflation(table: DataFrame, predictors=PREDICTORS) -> DataFrame:
    """Diagonal of the inverse correlation matrix (one small matrix)."""
    r = {(x.a, x.b): x.r for x in predictor_correlations(table, predictors).collect()}
    inverse = np.linalg.inv(np.array([[r[a, b] for b in predictors] for a in predictors]))
    rows = [(p, float(inverse[i, i])) for i, p in enumerate(predictors)]
    return table.sparkSession.createDataFrame(rows, "predictor string, vif double")


def _likelihood_terms(table: DataFrame, predictors, group: str) -> DataFrame:
    """Per group: n and the sums of products of intercept, predictors and response."""
    cols = [F.lit(1.0), *[F.col(p) for p in predictors], F.col("y")]
    m = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(m) for j in range(i, m)]
    return table.groupBy(group).agg(*sums)


def _profile(sums: DataFrame, ratios: list[float], m: int) -> list[tuple]:
    """Sums of the generalised products for each variance ratio, added up over the groups in
    Spark; only m x m numbers per ratio reach the driver."""
    steps = F.array(*[F.lit(float(r)) for r in ratios])
    s = sums.withColumn("ratio", F.explode(steps))
    n = F.col("s0_0")
    shrink = F.col("ratio") / (1 + n * F.col("ratio"))
    aggs = [F.sum(F.col(f"s{i}_{j}") - shrink * F.col(f"s0_{i}") * F.col(f"s0_{j}")).alias(f"q{i}_{j}")
            for i in range(m) for j in range(i, m)]
    rows = s.groupBy("ratio").agg(*aggs, F.sum(F.log1p(n * F.col("ratio"))).alias("logdet"), F.sum(n).alias("n")).collect()
    out = []
    for row in rows:
        q = np.zeros((m, m))
        for i in range(m):
            for j in range(i, m):
                q[i, j] = q[j, i] = row[f"q{i}_{j}"]
        beta = np.linalg.solve(q[:-1, :-1], q[:-1, -1])
        variance = (q[-1, -1] - beta @ q[:-1, -1]) / row["n"]
        loglik = -0.5 * (row["n"] * (math.log(2 * math.pi * variance) + 1) + row["logdet"])
        out.append((loglik, row["ratio"], variance, beta, row["n"]))
    return sorted(out, key=lambda o: o[0])


def random_intercept_model(table: DataFrame, predictors=PREDICTORS, group: str = "site_id",
                           rounds: int = 4) -> dict:
    """Maximum-likelihood regression with a random intercept per group.

    The data is read once into sums of products per group. The likelihood then depends on one
    number, the ratio of the two variances, which is searched on a grid that is refined
    `rounds` times around its best point.
    """
    m = len(predictors) + 2
    # the group's intercept sums s0_i are part of the products because column 0 is the constant
    sums = cut_lineage(_likelihood_terms(table, predictors, group))
    grid = [0.0] + [10 ** (k / 4) for k in range(-24, 17)]
    best = _profile(sums, grid, m)[-1]
    width = 10 ** 0.25
    for _ in range(rounds):
        if best[1] == 0.0:
            break
        grid = [best[1] * width ** (k / 8) for k in range(-8, 9)]
        best, width = _profile(sums, grid, m)[-1], width ** (1 / 8)
    loglik, ratio, variance, beta, n = best
    k = len(beta) + 2
    return {"coefficients": dict(zip(("intercept", *predictors), map(float, beta))), "ratio": float(ratio),
            "residual_variance": float(variance), "group_variance": float(ratio * variance), "n": int(n),
            "log_likelihood": float(loglik), "aic": 2 * k - 2 * loglik, "bic": math.log(n) * k - 2 * loglik}


def fitted_values(table: DataFrame, model: dict, predictors=PREDICTORS, group: str = "site_id") -> DataFrame:
    """Fitted value (with the group's intercept) and residual of each row."""
    c = model["coefficients"]
    fixed = F.lit(c["intercept"])
    for p in predictors:
        fixed = fixed + c[p] * F.col(p)
    t = table.withColumn("fixed", fixed)
    ratio = model["ratio"]
    effect = t.groupBy(group).agg((ratio * F.sum(F.col("y") - F.col("fixed"))
                                   / (1 + F.count("*") * ratio)).alias("effect"))
    return t.join(effect, group).withColumn("fitted", F.col("fixed") + F.col("effect")).withColumn(
        "residual", F.col("y") - F.col("fitted")).drop("fixed", "effect")


def intercept_model_gradients(fitted: DataFrame, predictors=PREDICTORS) -> DataFrame:
    """Gradient of the likelihood for each coefficient at a fit of fitted_values, per row: residuals with the group
    effects taken out are the inverse covariance times those without, so their products with a predictor sum to 0."""
    terms = [F.struct(F.lit(name).alias("predictor"), F.avg(x * F.col("residual")).alias("gradient"))
             for name, x in (("intercept", F.lit(1.0)), *((p, F.col(p)) for p in predictors))]
    one = fitted.agg(F.count("*").alias("n"), F.array(*terms).alias("t"))
    return one.select("n", F.explode("t").alias("t")).select("t.predictor", "n", "t.gradient")
