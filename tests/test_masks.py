"""Masks as runs, by site and bout, against plain sets of pixels."""

import datetime
import random

from pyspark.sql import functions as F

from trackframe.operators import filters as fl, masks as mk

KEYS = ["site_id", "bout"]


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


def pixel_sets(seed=3):
    r = random.Random(seed)
    return {(s, b): {(r.randrange(300), r.randrange(12)) for _ in range(400)} for s in (1, 2) for b in ("a", "b")}


def as_pixels(spark, sets):
    return spark.createDataFrame([(*k, x, y) for k, v in sets.items() for x, y in v], "site_id int, bout string, x int, y int")


def test_runs_hold_the_same_pixels_and_never_touch(spark):
    sets = pixel_sets()
    runs = mk.runs_of(as_pixels(spark, sets).unionAll(as_pixels(spark, sets)), KEYS).cache()
    back = mk.pixels_of(runs, KEYS).collect()
    assert sorted((r.site_id, r.bout, r.x, r.y) for r in back) == sorted((*k, x, y) for k, v in sets.items() for x, y in v)
    starts = {(r.site_id, r.bout, r.y, r.x_from) for r in runs.collect()}
    assert not any((r.site_id, r.bout, r.y, r.x_to + 1) in starts for r in runs.collect())


def test_overlapping_touching_and_empty_runs_are_joined(spark):
    runs = spark.createDataFrame([(1, "a", 5, 0, 9), (1, "a", 5, 2, 3), (1, "a", 5, 10, 12), (1, "a", 5, 20, 25), (1, "a", 6, 4, 3),
                                  (1, "a", 5, 22, 30), (1, "b", 5, 7, 7)], "site_id int, bout string, y int, x_from int, x_to int")
    got = sorted((r.bout, r.y, r.x_from, r.x_to) for r in mk.joined_runs(runs, KEYS).collect())
    assert got == [("a", 5, 0, 12), ("a", 5, 20, 30), ("b", 5, 7, 7)]
    assert mk.pixels_of(runs, KEYS).count() == 13 + 11 + 1


def test_rows_meet_their_own_mask_as_with_pixels(spark):
    sets, r = pixel_sets(), random.Random(8)
    data = [(i, r.choice([1, 2, 3, None]), r.choice(["a", "b", "c", None]), x, y, x + 2, y + 2)
            for i in range(600) for x, y in [(r.randrange(-4, 302), r.randrange(-2, 13))]]
    boxes = spark.createDataFrame(data, "i int, site_id int, bout string, x1 int, y1 int, x2 int, y2 int")
    pixels, runs = as_pixels(spark, sets), mk.runs_of(as_pixels(spark, sets), KEYS)
    inside = {i for i, s, b, x, y, *_ in data if (x + 1, y + 1) in sets.get((s, b), ())}
    assert {row.i for row in mk.keep_on_runs(boxes, runs).collect()} == inside
    assert {row.i for row in fl.keep_on_mask(boxes, pixels, KEYS).collect()} == inside
    off = mk.drop_on_runs(boxes, runs)
    assert off.columns == boxes.columns and {row.i for row in off.collect()} == {row[0] for row in data} - inside


def test_bout_of_a_day(spark):
    """Gaps between bouts, overlaps, bouts that end before they start, other sites, null days and sites."""
    bouts = spark.createDataFrame([(1, day(0), day(9), "first"), (1, day(5), day(40), "second"), (1, day(5), day(6), "again"),
                                   (1, day(60), day(50), "never"), (2, day(3), day(3), "single")],
                                  "site_id int, first_day date, last_day date, bout string")
    days = [(s, day(n)) for s in (1, 2, 3) for n in range(-1, 62)] + [(1, None), (None, day(1)), (1, day(2))]
    got = mk.with_bout(spark.createDataFrame(days, "site_id int, day date").withColumn("first_day", F.lit("mine")), bouts)

    def expected(s, d):
        if d is None or s is None:
            return None
        n = (d - day(0)).days
        if s == 1:
            return "again" if n in (5, 6) else "second" if 5 <= n <= 40 else "first" if 0 <= n <= 4 else None
        return "single" if s == 2 and n == 3 else None

    rows = got.collect()
    assert len(rows) == len(days) and {r.first_day for r in rows} == {"mine"}
    assert all(r.bout == expected(r.site_id, r.day) for r in rows)
    empty = mk.with_bout(spark.createDataFrame([(1, day(2))], "site_id int, day date"), bouts.limit(0)).collect()
    assert [r.bout for r in empty] == [None]
