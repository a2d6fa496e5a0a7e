"""Bootstrap and permutation with draws that any engine can repeat.

A draw is the number in the first eight hex digits of md5(key | resample | position), so results
do not depend on partitioning. Draws are never rows: the values of a group lie in ordered chunks of bounded
length, a task gets a chunk with a range of resamples and a range of draws, makes the draws inside the row and
adds up the values it holds. Only sums leave the row, and are added over chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackframe.functions.ordering import with_position
from trackframe.session import cut_lineage


CHUNK = 65_536      # values of a group in one row
DRAWS = 16_384      # draws a row makes


def _first_digits(text: Column) -> Column:
    """The number in the first eight hex digits of the text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_text(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def _day_block(values: DataFrame, order) -> Column:
    """Blocks of 64 days when rows are ordered by date first."""
    by_date = list(order)[:1] == ["day"] and dict(values.dtypes)["day"] == "date"
    return F.floor(F.unix_date("day") / 64) if by_date else F.lit(0)


def bootstrap_means(values: DataFrame, group, columns, order, resamples: int = 10_000,
                    chunk: int = CHUNK) -> DataFrame:
    """Means of `columns` over each resample (with replacement) of each group.

    The values (one row per slot) are written once, as they are read for sizes and positions. A row holds at most
    `chunk` values and makes about DRAWS draws, or one resample's draws from one range. A group of n values in c
    chunks makes every draw c times, once for each chunk that may hold it; nothing is joined to the draws.
    The result lies by group: a group has one row per resample and range.
    """
    group, columns = list(group), list(columns)
    values = cut_lineage(values.select(*dict.fromkeys([*group, *order, *columns])))
    indexed = with_position(values, group, order, _day_block(values, order), out="_pos", rows_out="_n")
    place = F.col("_pos") - 1
    rows = F.sort_array(F.collect_list(F.struct(place.alias("_at"), *[F.col(c).cast("double").alias(c) for c in columns])))
    chunks = (indexed.withColumn("_chunk", F.floor(place / F.lit(chunk))).groupBy(*group, "_n", "_chunk")
              .agg(rows.alias("_rows")))
    range_draws = F.least(F.col("_n"), F.lit(chunk))
    per_row = F.greatest(F.lit(1), F.floor(F.lit(DRAWS) / range_draws)).cast("int")
    # a number of tasks by work: the rows are small, and would be put together by size
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first, start = F.col("_range") * chunk, F.col("_from") * F.col("_per")
    numbers = F.sequence(start, F.least(F.lit(resamples), start + F.col("_per")) - 1)
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in group])
    # arrays that are read once per draw are made before the shuffle, so that they are not made again per draw
    work = (chunks.withColumn("_per", per_row)
            .withColumn("_from", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(resamples) / F.col("_per")).cast("int") - 1)))
            .withColumn("_range", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.lit(chunk)))))
            .select(*group, "_n", "_chunk", "_from", "_range", numbers.alias("_b"),
                    F.transform(F.sequence(first, F.least(F.col("_n"), first + chunk) - 1), lambda i: i.cast("string")).alias("_i"),
                    F.transform(numbers, lambda b: F.concat(key, F.lit("|"), b.cast("string"), F.lit("|"))).alias("_key"),
                    *[F.col("_rows").getField(c).alias(f"_v_{c}") for c in columns])
            .repartition(tasks, *group, "_chunk", "_from", "_range"))

    def drawn(head):
        return F.transform("_i", lambda i: (_first_digits(F.concat(head, i)) % F.col("_n") - F.col("_chunk") * chunk).cast("int"))

    work = work.withColumn("_drawn", F.transform("_key", drawn))

    def total(held):
        return F.transform("_drawn", lambda at: F.aggregate(
            at, F.lit(0.0), lambda s, p: s + F.coalesce(F.get(held, p), F.lit(0.0))))

    def known(held):
        one = F.lit(1).cast("long")
        every = (F.col("_n") <= chunk) & ~F.exists(held, lambda v: v.isNull())  # every draw has a value
        return F.when(every, F.transform("_drawn", lambda at: F.size(at).cast("long"))).otherwise(
            F.transform("_drawn", lambda at: F.aggregate(at, one - 1, lambda n, p: n + F.when(F.get(held, p).isNotNull(), one).otherwise(0))))

    folded = work.select(*group, "_b", *[total(F.col(f"_v_{c}")).alias(f"_s_{c}") for c in columns],
                         *[known(F.col(f"_v_{c}")).alias(f"_c_{c}") for c in columns])
    parts = F.arrays_zip("_b", *[f"_s_{c}" for c in columns], *[f"_c_{c}" for c in columns])
    # sums are few enough to lie by group, which serves the two aggregates that follow
    rows = folded.repartition(*group).select(*group, F.explode(parts).alias("_part")).select(*group, "_part.*")
    return rows.groupBy(*group, F.col("_b").alias("resample")).agg(*[
        (F.sum(f"_s_{c}") / F.when(F.sum(f"_c_{c}") > 0, F.sum(f"_c_{c}"))).alias(c) for c in columns])


def intervals(means: DataFrame, group, columns, level: float = 0.95) -> DataFrame:
    """Mean and percentile interval of the resampled means of each column."""
    tail = (1 - level) / 2
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"),
                 F.percentile(c, F.lit(tail)).alias(f"{c}_low"),
                 F.percentile(c, F.lit(1 - tail)).alias(f"{c}_high")]
    return means.groupBy(*group).agg(*aggs)


def bootstrap_intervals(values: DataFrame, group, columns, order, resamples: int = 10_000) -> DataFrame:
    return intervals(bootstrap_means(values, group, columns, order, resamples), group, columns)


def difference_verdicts(ci: DataFrame, column: str) -> DataFrame:
    """Significant when the interval leaves out 0; label of the dominant direction."""
    sig = (F.col(f"{column}_low") > 0) | (F.col(f"{column}_high") < 0)
    return ci.withColumn("significant", sig).withColumn(
        "label", F.when(sig & (F.col(f"{column}_mean") > 0), "away").when(sig, "toward").otherwise("balanced"))


def shares_above_below(means: DataFrame, group, column: str, level: float = 0.0) -> DataFrame:
    """Share of resampled means above and below a level."""
    one = [F.avg((F.col(column) > level).cast("double")).alias("p_above"),
           F.avg((F.col(column) < level).cast("double")).alias("p_below")]
    return means.groupBy(*group).agg(*one)


def band_contrasts(matrix: DataFrame, group, value: str = "similarity", offsets=(1, 2)) -> DataFrame:
    """Mean of the diagonal minus the mean of the means of the near-diagonal bands."""
    gap = F.abs(F.col("i") - F.col("j"))
    bands = [F.avg(F.when(gap == k, F.col(value))) for k in offsets]
    known = sum((F.when(b.isNotNull(), 1).otherwise(0) for b in bands), F.lit(0))
    total = sum((F.coalesce(b, F.lit(0.0)) for b in bands), F.lit(0.0))
    diagonal = F.avg(F.when(gap == 0, F.col(value)))
    return matrix.groupBy(*group).agg(
        diagonal.alias("diagonal"), F.when(known > 0, total / known).alias("neighbours")
    ).withColumn("contrast", F.col("diagonal") - F.col("neighbours"))


def permuted_entries(matrix: DataFrame, group, block: Column, resamples: int = 1000,
                     value: str = "similarity") -> DataFrame:
    """Matrices whose known entries are shuffled inside each block. A window holds the
    entries of one block of one matrix (at most 24 x 24), one resample at a time."""
    group = list(group)
    many = (matrix.filter(F.col(value).isNotNull()).withColumn("_block", block)
            .withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))))
    part = [*group, "resample", "_block"]
    h = hash_text(*[F.col(c) for c in group], F.col("resample"), F.col("i"), F.col("j"))
    place = Window.partitionBy(*part).orderBy("i", "j")
    draw = Window.partitionBy(*part).orderBy("_h", "i", "j")
    ranked = many.withColumn("_h", h).select(
        *part, "i", "j", value, F.row_number().over(place).alias("_place"),
        F.row_number().over(draw).alias("_draw"))
    places = ranked.select(*part, "i", "j", F.col("_place").alias("_k"))
    draws = ranked.select(*part, F.col("_draw").alias("_k"), value)
    return places.join(draws, [*part, "_k"]).drop("_k", "_block")


def permuted_columns(matrix: DataFrame, group, n: int, resamples: int = 1000,
                     value: str = "similarity") -> DataFrame:
    """Matrices whose columns are put in a random order."""
    group = list(group)
    cols = (matrix.select(*group).distinct()
            .withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
            .repartition(*group, "resample")
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))))
    h = hash_text(*[F.col(c) for c in group], F.col("resample"), F.col("j"))
    new = Window.partitionBy(*group, "resample").orderBy("_h", "j")
    order = cols.withColumn("_h", h).select(*group, "resample", "j",
                                            (F.row_number().over(new) - 1).alias("_new"))
    return (matrix.join(order, [*group, "j"])
            .select(*group, "resample", "i", F.col("_new").alias("j"), value))


def band_strength(matrix: DataFrame, permuted: DataFrame, group, offsets=(1, 2),
                  value: str = "similarity") -> DataFrame:
    """Observed contrast and the share of permuted contrasts that reach it."""
    observed = band_contrasts(matrix, group, value, offsets)
    null = (band_contrasts(permuted, [*group, "resample"], value, offsets)
            .filter(F.col("contrast").isNotNull()).select(*group, F.col("contrast").alias("null_contrast")))
    joined = observed.join(null, list(group), "left")
    hit = (F.col("null_contrast") >= F.col("contrast")).cast("double")
    return joined.groupBy(*group).agg(
        F.first("diagonal").alias("diagonal"), F.first("neighbours").alias("neighbours"),
        F.first("contrast").alias("contrast"), F.avg(hit).alias("p_value"),
        F.count("null_contrast").alias("n_null"))


def shuffled_cells(vectors: DataFrame, group, value: str, nx: int = 96, ny: int = 54) -> DataFrame:
    """Each vector's values moved to random distinct cells of the grid: same values, no
    spatial structure. Windows hold the cells of one vector (at most the grid)."""
    group = list(group)
    grid = (vectors.select(*group).distinct()
            .withColumn("x_bin", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
            .withColumn("y_bin", F.explode(F.sequence(F.lit(0), F.lit(ny - 1)))))
    h = hash_text(*[F.col(c) for c in group], F.col("x_bin"), F.col("y_bin"))
    free = Window.partitionBy(*group).orderBy("_h", "x_bin", "y_bin")
    cells = grid.withColumn("_h", h).select(*group, "x_bin", "y_bin", F.row_number().over(free).alias("_k"))
    order = Window.partitionBy(*group).orderBy("x_bin", "y_bin")
    filled = vectors.select(*group, value, F.row_number().over(order).alias("_k"))
    return cells.join(filled, [*group, "_k"]).drop("_k")
