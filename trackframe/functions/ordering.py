"""Row order inside groups, without sorting a whole group in one task.

A group (a track, a day, a cluster) may be far larger than the others, so order is taken
inside *blocks* of a group first. What crosses a block border - the row before the first
one, the number of rows so far - comes from one summary row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackframe.session import cut_lineage

FRAME_BLOCK = 4096  # frames per block of a track


def frame_block(frame: str = "frame_number", width: int = FRAME_BLOCK) -> Column:
    return F.floor(F.col(frame) / F.lit(width))


def _ordering(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _key(order) -> Column:
    cols = _ordering(order)
    return cols[0] if len(cols) == 1 else F.struct(*cols)


def first_row(fields, order) -> Column:
    """The fields of the first row of a group, as an aggregate. One value per field and a plain
    ordering column (tracks have one row per frame) keep the aggregation hash-based."""
    return F.struct(*[F.min_by(f, _key(order)).alias(f) for f in fields])


def last_row(fields, order) -> Column:
    return F.struct(*[F.max_by(f, _key(order)).alias(f) for f in fields])


def with_previous(df: DataFrame, keys, order, fields, block: Column | None = None,
                  out: str = "prev", rows_out: str = "track_rows") -> DataFrame:
    """Add the previous row of each group as struct `out` and the group's row count.

    `block` must not decrease along `order`. The only work per whole group is over one
    summary row per block.
    """
    keys = list(keys)
    block = frame_block() if block is None else block
    row = F.struct(*[F.col(f) for f in fields])
    df = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(*_ordering(order))
    across = Window.partitionBy(*keys).orderBy("_block")
    ends = df.groupBy(*keys, "_block").agg(
        last_row(fields, order).alias("_last"), F.count("*").alias("_n"))
    summary = ends.select(
        *keys, "_block",
        F.lag("_last").over(across).alias("_carry"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(rows_out))
    return (df.withColumn(out, F.lag(row).over(inside))
            .join(summary, [*keys, "_block"])
            .withColumn(out, F.coalesce(F.col(out), F.col("_carry")))
            .drop("_carry", "_block"))


def with_position(df: DataFrame, keys, order, block: Column | None = None,
                  out: str = "position", rows_out: str = "track_rows") -> DataFrame:
    """Add the 1-based position of each row in its group and the group's row count."""
    keys = list(keys)
    block = frame_block() if block is None else block
    df = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(*_ordering(order))
    across = Window.partitionBy(*keys).orderBy("_block")
    sizes = df.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        *keys, "_block",
        (F.sum("_n").over(across) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(rows_out))
    return (df.withColumn("_rn", F.row_number().over(inside))
            .join(offsets, [*keys, "_block"])
            .withColumn(out, F.col("_before") + F.col("_rn"))
            .drop("_before", "_rn", "_block"))


def over_blocks(df: DataFrame, keys, before: int, after: int, columns, block_rows: int = FRAME_BLOCK,
                position: str = "position") -> DataFrame:
    """Window columns that look at most `before` rows back and `after` rows ahead.

    Rows that close to a border of a block of positions are also sent to the neighbouring
    block, so every window stays inside one block. `columns` makes the columns of a window.
    """
    keys = list(keys)
    pos = F.col(position) - 1
    spread = df.withColumn("_home", F.floor(pos / block_rows)).withColumn("_block", F.explode(F.sequence(
        F.floor((pos - after) / block_rows), F.floor((pos + before) / block_rows))))
    w = Window.partitionBy(*keys, "_block").orderBy(position)
    return (spread.select("*", *columns(w)).filter(F.col("_block") == F.col("_home"))
            .drop("_block", "_home"))


def with_neighbours(df: DataFrame, keys, fields, radius: int, block_rows: int = FRAME_BLOCK,
                    position: str = "position") -> DataFrame:
    """Add `<field>_m1.._m<r>` (rows before) and `<field>_p1.._p<r>` (rows after)."""
    def columns(w):
        return [shift(f, n).over(w).alias(f"{f}_{s}{n}") for f in fields for n in range(1, radius + 1)
                for s, shift in (("m", F.lag), ("p", F.lead))]
    return over_blocks(df, keys, radius, radius, columns, block_rows, position)


def tracks_with_at_least(df: DataFrame, keys, min_rows: int) -> DataFrame:
    """Rows of groups with at least min_rows rows. Counts are combined before the shuffle
    and the join back is an equi-join that AQE can split when a group is hot."""
    long_enough = (df.groupBy(*keys).agg(F.count("*").alias("_n"))
                   .filter(F.col("_n") >= min_rows).drop("_n"))
    return df.join(long_enough, list(keys), "left_semi")


def value_ranks(df: DataFrame, group, value: str, block: Column | None = None, extra=(),
                out: str = "rank") -> DataFrame:
    """One row per distinct value of a group: its average rank, its count `n` and the `extra`
    aggregates of its rows.

    `block` is a coarse step function of `value` (for scores in 0..1 for instance
    floor(1024 * score)); running counts are taken inside blocks and shifted by block totals,
    so a group with many values is never sorted in one task.
    """
    group = list(group)
    tallies = df.groupBy(*group, value).agg(F.count("*").alias("n"), *extra)
    if block is None:
        upto = F.sum("n").over(Window.partitionBy(*group).orderBy(value))
        return tallies.withColumn(out, upto - F.col("n") + (F.col("n") + 1) / 2.0)
    tallies = cut_lineage(tallies.withColumn("_block", block))
    across = Window.partitionBy(*group).orderBy("_block")
    before = tallies.groupBy(*group, "_block").agg(F.sum("n").alias("_n")).select(
        *group, "_block", (F.sum("_n").over(across) - F.col("_n")).alias("_before"))
    upto = F.sum("n").over(Window.partitionBy(*group, "_block").orderBy(value))
    return (tallies.withColumn("_upto", upto).join(before, [*group, "_block"])
            .withColumn(out, F.col("_before") + F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2.0)
            .drop("_before", "_upto", "_block"))


def ranks_in_small_groups(group, value: str) -> Column:
    """Ranks with ties averaged for groups of bounded size (the hours of a day). Both windows
    share one shuffle by group."""
    group = list(group)
    ties = F.count("*").over(Window.partitionBy(*group, value))
    return F.rank().over(Window.partitionBy(*group).orderBy(value)) + (ties - 1) / 2.0


def exact_percentile(df: DataFrame, group, value: str, share: float, buckets: int = 4096,
                     out: str = "percentile", most: int = 1_000_000) -> DataFrame:
    """Exact interpolated percentile per group for groups of any size.

    Equal values are combined, counts per value range find the range that holds the wanted
    rank, and only that range is put in order. While a range holds more than `most` distinct
    values, as when an outlier makes ranges wide, it is divided again between its own least and
    greatest value. No group is held in one aggregation buffer.
    """
    group = list(group)
    keyed = df.filter(F.col(value).isNotNull()).select(*group, F.lit(1).alias("_all"), F.col(value).alias("_v"))
    key = [*group, "_all"]
    tallies = cut_lineage(keyed.groupBy(*key, "_v").agg(F.count("*").alias("_n")))
    rows = tallies.withColumn("_r", F.lit(0))
    ranges = rows.groupBy(*key, "_r").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_total"),
                                          F.lit(0).cast("long").alias("_base"))
    width = F.col("_hi") / 2 - F.col("_lo") / 2  # halves do not overflow
    bucket = F.when(width > 0, F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / width * buckets), F.lit(buckets - 1))
                    ).otherwise(F.lit(0))
    spot = share * (F.col("_total") - 1)
    low, high = F.floor(spot), F.ceil(spot)
    before = F.col("_base") + F.sum("_bn").over(Window.partitionBy(*key, "_r").orderBy("_b")) - F.col("_bn")
    largest = None
    while True:
        placed = rows.join(ranges, [*key, "_r"]).withColumn("_b", bucket)
        sizes = placed.groupBy(*key, "_r", "_b").agg(
            F.sum("_n").alias("_bn"), F.count("*").alias("_values"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
            F.first("_total").alias("_total"), F.first("_base").alias("_base"))
        wanted = cut_lineage(sizes.withColumn("_before", before).filter(
            (F.col("_before") <= high) & (low < F.col("_before") + F.col("_bn"))).drop("_base", "_bn"))
        rows = placed.select(*key, "_r", "_b", "_v", "_n").join(wanted, [*key, "_r", "_b"])
        size = wanted.agg(F.max("_values")).first()[0] or 0
        if size <= most or size == largest:
            break
        largest = size
        # at most two ranges of a group hold the ranks on either side of the spot
        number = F.row_number().over(Window.partitionBy(*key).orderBy("_before"))
        ranges = wanted.select(*key, F.col("_r").alias("_of"), "_b", "_lo", "_hi", "_total", F.col("_before").alias("_base"),
                               number.alias("_r"))
        rows = cut_lineage(rows.select(*key, F.col("_r").alias("_of"), "_b", "_v", "_n").join(
            ranges.select(*key, "_of", "_b", "_r"), [*key, "_of", "_b"]).select(*key, "_r", "_v", "_n"))
        ranges = ranges.drop("_of", "_b")
    inside = Window.partitionBy(*key, "_r", "_b").orderBy("_v")
    rows = rows.withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
    start = F.col("_end") - F.col("_n")

    def at(rank):
        return F.max(F.when((start <= rank) & (rank < F.col("_end")), F.col("_v")))

    picked = rows.groupBy(*key).agg(at(low).alias("_v0"), at(high).alias("_v1"), F.first(spot - low).alias("_part"))
    return picked.select(*group, (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.col("_part")).alias(out))
