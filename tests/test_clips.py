"""Tables stored per clip, and branches of trail graphs."""

from pyspark.sql import functions as F

from trackframe.operators import branches as br
from trackframe.sources import clips


def rows(spark, data):
    return spark.createDataFrame(data, "site_id int, day date, video_id int, value double")


def doubled(df):
    return df.select("site_id", "day", "video_id", (F.col("value") * 2).alias("twice"))


def test_only_new_and_changed_clips_are_computed(spark, tmp_path):
    import datetime
    path, day = f"{tmp_path}/table", datetime.date(2024, 1, 2)
    first = [(1, day, v, float(i)) for v in range(4) for i in range(3)]
    assert clips.store_clips(rows(spark, first), path, doubled).count() == 4
    assert clips.store_clips(rows(spark, first[::-1]), path, doubled).count() == 0
    changed = [(s, d, v, x + 100 if v == 2 else x) for s, d, v, x in first] + [(2, day, 9, 5.0)]
    seen = []

    def compute(df):
        seen.extend(r[0] for r in df.select("video_id").distinct().collect())
        return doubled(df)

    got = clips.stored_clips(rows(spark, changed), path, compute)
    assert sorted(seen) == [2, 9]
    assert sorted((r["video_id"], r["twice"]) for r in got.collect()) == sorted((v, 2 * x) for _, _, v, x in changed)
    part = clips.stored_clips(rows(spark, first[:3]), path, compute)
    assert {r["video_id"] for r in part.collect()} == {0} and sorted(seen) == [2, 9]


def test_branches_of_a_small_graph(spark):
    # a ring of eight cells with a tail of two; the tail's end is the only endpoint
    ring = [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1)]
    links = [(1, a[0] + 96 * a[1], b[0] + 96 * b[1]) for a, b in zip(ring, ring[1:] + ring[:1])] + [(1, 2, 3), (1, 3, 4)]
    both = spark.createDataFrame(links + [(s, b, a) for s, a, b in links], "site_id int, node int, other int")
    ends = spark.createDataFrame([(1, 4), (1, 500)], "site_id int, node int")
    junctions = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 0, 0), (1, 2, 50, 50)], "site_id int, rank int, x_bin int, y_bin int")
    got = br.unique_branches(None, junctions, graph=both, ends=ends).orderBy("rank", "seq").collect()
    assert all(r["node"] == 4 for r in got)
    paths = {k: [(r["x_bin"], r["y_bin"]) for r in got if r["rank"] == k] for k in (0, 1)}
    assert paths[1] == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)]
    assert paths[0] == [(0, 2), (0, 1), (0, 0), (1, 0), (2, 0), (3, 0), (4, 0)] and len(got) == 12
