"""The tracker against a plain one: full filter matrices and every possible assignment."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.operators import tracking as tg


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def z_of(b):
    w, h = b[2] - b[0], b[3] - b[1]
    return np.array([b[0] + w / 2, b[1] + h / 2, w * h, w / h])


def box_of(x):
    w = np.sqrt(x[2] * x[3])
    h = x[2] / w
    return [x[0] - w / 2, x[1] - h / 2, x[0] + w / 2, x[1] + h / 2]


def best(gain):
    """The assignment of largest sum by trying all."""
    n, m = gain.shape
    if n > m:
        return [(r, c) for c, r in best(gain.T)]
    return max((list(enumerate(p)) for p in itertools.permutations(range(m), n)), key=lambda p: sum(gain[i, j] for i, j in p))


def plain(frames, max_age, min_hits, threshold):
    """{(frame, seq): (first frame, first seq, reported, filtered box)} for [(frame, [box, ...]), ...]."""
    step = np.eye(7)
    step[[0, 1, 2], [4, 5, 6]] = 1
    look = np.eye(4, 7)
    noise, error = np.diag([1, 1, 1, 1, 0.01, 0.01, 0.0001]), np.diag([1.0, 1, 10, 10])
    open_, out = [], {}
    for count, (frame, boxes) in enumerate(frames, 1):
        for t in open_:
            if t["x"][6] + t["x"][2] <= 0:
                t["x"][6] = 0
            t["x"], t["p"] = step @ t["x"], step @ t["p"] @ step.T + noise
            t["streak"] = 0 if t["since"] > 0 else t["streak"]
            t["since"] += 1
        gain = np.array([[overlap(box_of(t["x"]), b) for b in boxes] for t in open_]).reshape(len(open_), len(boxes))
        sure = gain > threshold
        if gain.size and sure.sum(axis=0).max() <= 1 and sure.sum(axis=1).max() <= 1:
            pairs = [tuple(p) for p in np.argwhere(sure)]
        else:
            pairs = [(i, j) for i, j in best(gain) if gain[i, j] >= threshold] if gain.size else []
        held = {j: open_[i] for i, j in pairs}
        for j, b in enumerate(boxes):
            if j in held:
                t = held[j]
                k = t["p"] @ look.T @ np.linalg.inv(look @ t["p"] @ look.T + error)
                t["x"], t["p"] = t["x"] + k @ (z_of(b) - look @ t["x"]), (np.eye(7) - k @ look) @ t["p"]
                t["since"], t["streak"] = 0, t["streak"] + 1
            else:
                t = held[j] = {"x": np.append(z_of(b), [0, 0, 0]), "p": np.diag([10.0] * 4 + [1e4] * 3), "since": 0, "streak": 0, "name": (frame, j)}
                open_.append(t)
            out[frame, j] = (*t["name"], t["streak"] >= min_hits or count <= min_hits, box_of(t["x"]))
        open_ = [t for t in open_ if t["since"] <= max_age]
    return out


def scene(seed, n_frames, n, crowd):
    """Boxes that move, shake, meet and vanish for a while; some frames have none."""
    rng = np.random.default_rng(seed)
    at, v = rng.random((n, 2)) * crowd, rng.normal(size=(n, 2)) * 3
    frames = []
    for f in range(n_frames):
        at = at + v + rng.normal(size=(n, 2)) * 0.7
        seen = [k for k in range(n) if rng.random() < 0.85]
        if seen and rng.random() < 0.9:
            frames.append((f * 2, [[*at[k], *(at[k] + [20 + k, 17 + rng.random()])] for k in seen]))
    return frames


@pytest.mark.parametrize("frames", [3, 8192])
@pytest.mark.parametrize("max_age, min_hits", [(7, 1), (2, 3)])
def test_tracks_equal_a_plain_tracker(spark, frames, max_age, min_hits):
    scenes = {v: scene(v, 25 if v < 4 else 7, 5, 60) for v in range(6)}
    rows = [(v, f, k, *map(float, b)) for v, s in scenes.items() for f, boxes in s for k, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "video_id long, frame_number int, seq long, x1 double, y1 double, x2 double, y2 double")
    got = tg.tracked(df.repartition(5), max_age=max_age, min_hits=min_hits, frames=frames).collect()
    assert len(got) == len(rows)
    want = {v: plain(s, max_age, min_hits, 0.1) for v, s in scenes.items()}
    assert len({(r["video_id"], r["first_frame"], r["first_seq"]) for r in got}) < len(rows) / 2
    for r in got:
        first, seq, reported, box = want[r["video_id"]][r["frame_number"], r["seq"]]
        assert (r["first_frame"], r["first_seq"], r["reported"]) == (first, seq, reported)
        assert np.allclose([r["fx1"], r["fy1"], r["fx2"], r["fy2"]], box, atol=1e-6)


def test_assignment_is_the_best_of_all():
    rng = np.random.default_rng(3)
    for _ in range(200):
        gain = rng.random(rng.integers(1, 6, 2)) * (rng.random() < 0.9)
        pairs = tg.best_assignment(gain)
        assert len(pairs) == min(gain.shape) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        assert np.isclose(sum(gain[p] for p in pairs), sum(gain[p] for p in best(gain)))


def test_boxes_without_area_and_no_boxes(spark):
    schema = "video_id long, frame_number int, seq long, x1 double, y1 double, x2 double, y2 double"
    flat = spark.createDataFrame([(1, f, 0, 5.0, 5.0, 5.0, 5.0) for f in range(3)], schema)
    assert {r["first_frame"] for r in tg.tracked(flat).collect()} == {0, 1, 2}
    assert tg.tracked(flat.filter(F.lit(False))).count() == 0


def test_few_rows_are_assigned_like_many(monkeypatch):
    rng = np.random.default_rng(8)
    for _ in range(300):
        gain = rng.integers(0, 5, rng.integers(1, 8, 2)) / 4  # with ties
        few = tg.best_assignment(gain)
        monkeypatch.setattr(tg, "FEW", 0)
        assert few == tg.best_assignment(gain)
        monkeypatch.undo()


def test_edges_by_connected_group():
    groups = tg._groups([0, 1, 2, 2, 4, 3], [0, 1, 0, 1, 5, 7])
    assert sorted(sorted(g) for g in groups) == [[0, 1, 2, 3], [4], [5]]


def test_longest_videos_do_not_share_a_task(spark):
    rows = spark.createDataFrame([(v, f) for v, n in enumerate([2, 9, 1, 8, 7]) for f in range(n)], "video int, f int")
    assert sorted(map(tuple, tg._places(rows, 3).collect())) == [(1, 0), (3, 1), (4, 2)]


def test_links_of_blocks_equal_links_by_joins(spark):
    from trackframe.operators import linking as ln
    rows = [(v, f, k, *map(int, b)) for v in range(4) for f, boxes in scene(v, 60, 5, 60) for k, b in enumerate(boxes)]
    rows += [(9, 3 * f, 0, 4 * f, 10, 4 * f + 20, 30) for f in range(70)]  # one chain over many blocks
    df = spark.createDataFrame(rows, "video_id int, frame_number int, seq long, x1 int, y1 int, x2 int, y2 int")
    cols = ("video_id", "frame_number", "seq", "first_frame", "first_seq")

    def found(**how):
        t = ln.linked_tracks(df.repartition(3), **how)
        assert t.dtypes == [(c, "int" if c[-3:] != "seq" else "bigint") for c in cols]
        return sorted(map(tuple, t.select(*cols).collect()))

    want = found(block_boxes=0)
    assert len(want) == len(rows) and {r[3:] for r in want if r[0] == 9} == {(0, 0)}
    assert found() == want and found(frames=8) == want and found(frames=7) == want
    assert found(frames=16, block_boxes=30) == want
