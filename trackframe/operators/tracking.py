"""Tracks from detections by prediction and optimal assignment.

A track predicts its next box with constant velocity (a Kalman filter of centre, area and aspect ratio). The boxes
of a frame are assigned to the predicted boxes so that the sum of overlaps is largest; assigned pairs that overlap
too little are undone. Boxes without a track open one, tracks that miss more than `max_age` frames are closed.
Frames without boxes do not count.

The work of a frame depends on the frame before, so a video is walked in order, but in blocks of frames: every
round takes one block of all videos, and what goes on to the next is one row per open track. A task never holds
more than the open tracks and one frame, and reads at most a block of a video.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trackframe.functions.ordering import with_position
from trackframe.session import checkpoint_dir, cut_lineage

BOX = ("x1", "y1", "x2", "y2")
FRAMES = 8192       # frames of a block
FEW = 1024          # entries of a group's table that are walked as plain numbers
# Variances of the filter, for centre x, centre y, area, aspect: first position and velocity, their growth in a
# frame, and the measurement's (fixed values)
FIRST, FIRST_VELOCITY = 10.0, 10_000.0
GROWTH, GROWTH_VELOCITY = 1.0, np.array([0.01, 0.01, 0.0001])
MEASURED = np.array([1.0, 1.0, 10.0, 10.0])


def measured(boxes: np.ndarray) -> np.ndarray:
    """Centre, area and aspect of corner boxes."""
    w, h = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.column_stack([boxes[:, 0] + w / 2, boxes[:, 1] + h / 2, w * h, w / h])


def corners(position: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.sqrt(position[:, 2] * position[:, 3])
        h = position[:, 2] / w
    half = np.column_stack([w / 2, h / 2])
    return np.concatenate([position[:, :2] - half, position[:, :2] + half], axis=1)


def overlaps(a: np.ndarray, b: np.ndarray, rows: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b, share of the union) of boxes that overlap."""
    found = []
    area_b = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    for at in range(0, len(a), rows):
        part = a[at:at + rows, None, :]
        w = np.minimum(part[..., 2], b[:, 2]) - np.maximum(part[..., 0], b[:, 0])
        h = np.minimum(part[..., 3], b[:, 3]) - np.maximum(part[..., 1], b[:, 1])
        i, j = np.nonzero((w > 0) & (h > 0))
        both = w[i, j] * h[i, j]
        area_a = ((part[..., 2] - part[..., 0]) * (part[..., 3] - part[..., 1]))[i, 0]
        found.append((i + at, j, both / (area_a + area_b[j] - both)))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of largest total gain, every row or column of the shorter side in one pair.

    Rows are added one by one; each is led to a free column by the cheapest path of exchanges, measured against
    row and column prices that keep all pairs so far optimal.
    """
    if gain.shape[0] > gain.shape[1]:
        return sorted((r, c) for c, r in best_assignment(gain.T))
    if gain.size <= FEW:
        return _best_of_few((-gain).tolist())
    cost = -gain
    n, m = cost.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    holder = np.full(m, -1)
    for new in range(n):
        least, via = np.full(m, np.inf), np.full(m, -1)
        visited = np.zeros(m, bool)
        row, column = new, -1
        while True:
            reached = cost[row] - row_price[row] - column_price + (least[column] if column >= 0 else 0.0)
            better = ~visited & (reached < least)
            least[better], via[better] = reached[better], column
            column = int(np.where(visited, np.inf, least).argmin())
            if holder[column] < 0:
                break
            visited[column] = True
            row = holder[column]
        end = least[column]
        row_price[new] += end
        seen = np.flatnonzero(visited)
        row_price[holder[seen]] += end - least[seen]
        column_price[seen] -= end - least[seen]
        while column >= 0:
            before = via[column]
            holder[column] = holder[before] if before >= 0 else new
            column = before
    return sorted((int(r), c) for c, r in enumerate(holder) if r >= 0)


def _best_of_few(cost: list[list[float]]) -> list[tuple[int, int]]:
    """The same steps on plain numbers: most groups have a few rows, and array calls would take longer than the work."""
    n, m = len(cost), len(cost[0])
    row_price, column_price, holder = [0.0] * n, [0.0] * m, [-1] * m
    for new in range(n):
        least, via, free, seen = [math.inf] * m, [-1] * m, list(range(m)), []
        row, column, so_far = new, -1, 0.0
        while True:
            costs, price, low, nearest = cost[row], row_price[row], math.inf, -1
            for c in free:
                reached = costs[c] - price - column_price[c] + so_far
                if reached < least[c]:
                    least[c], via[c] = reached, column
                if least[c] < low:
                    low, nearest = least[c], c
            column, so_far = nearest, low
            if holder[column] < 0:
                break
            free.remove(column)
            seen.append(column)
            row = holder[column]
        row_price[new] += so_far
        for c in seen:
            row_price[holder[c]] += so_far - least[c]
            column_price[c] -= so_far - least[c]
        while column >= 0:
            before = via[column]
            holder[column] = holder[before] if before >= 0 else new
            column = before
    return sorted((r, c) for c, r in enumerate(holder) if r >= 0)


def _groups(t: list[int], b: list[int]) -> list[list[int]]:
    """Edges (t, b) by connected group: an edge joins the group of its row with that of its column, the smaller one
    into the larger."""
    of_row, of_column = {}, {}
    for k, (i, j) in enumerate(zip(t, b)):
        mine, other = of_row.get(i), of_column.get(j)
        if mine is None:
            mine = other if other is not None else []
        elif other is not None and other is not mine:
            if len(mine) < len(other):
                mine, other = other, mine
            for e in other:
                of_row[t[e]] = of_column[b[e]] = mine
            mine += other
        mine.append(k)
        of_row[i] = of_column[j] = mine
    return list({id(g): g for g in of_row.values()}.values())


def assigned(predicted: np.ndarray, boxes: np.ndarray, min_overlap: float) -> list[tuple[int, int]]:
    """Pairs (track, box). Overlaps that already pair off one to one are taken as they are; else the largest sum of
    overlaps is sought in each group of tracks and boxes that are connected by overlaps."""
    t, b, share = overlaps(predicted, boxes)
    sure = share > min_overlap
    if not len(t):
        return []
    if np.bincount(t[sure], minlength=1).max() <= 1 and np.bincount(b[sure], minlength=1).max() <= 1:
        return list(zip(t[sure].tolist(), b[sure].tolist()))
    out = []
    t, b, share = t.tolist(), b.tolist(), share.tolist()
    for edges in _groups(t, b):
        if len(edges) == 1:
            e = edges[0]
            if share[e] >= min_overlap:
                out.append((t[e], b[e]))
            continue
        rows, columns = sorted({t[e] for e in edges}), sorted({b[e] for e in edges})
        row, column = {v: k for k, v in enumerate(rows)}, {v: k for k, v in enumerate(columns)}
        gain = np.zeros((len(rows), len(columns)))
        gain[[row[t[e]] for e in edges], [column[b[e]] for e in edges]] = [share[e] for e in edges]
        pairs = best_assignment(gain)
        gain = gain.tolist()
        out += [(rows[r], columns[c]) for r, c in pairs if gain[r][c] >= min_overlap and gain[r][c] > 0]
    return sorted(out)


class Tracks:
    """The open tracks of a video, one column of `state` each: position (4), velocity (3), variance of position (3),
    covariance (3), variance of velocity (3), variance of the aspect, frames since a hit, hits in a row."""

    POSITION, VELOCITY, SPREAD, BOTH, SPREAD_VELOCITY = (slice(*c) for c in ((0, 4), (4, 7), (7, 10), (10, 13), (13, 16)))
    ASPECT, SINCE, STREAK, NUMBERS = 16, 17, 18, 19

    def __init__(self, max_age: int, min_hits: int, min_overlap: float):
        self.max_age, self.min_hits, self.min_overlap = max_age, min_hits, min_overlap
        self.names: list[tuple[int, int]] = []
        self.state = np.zeros((self.NUMBERS, 0))

    def keep(self, which: np.ndarray) -> None:
        if not which.all():
            self.names = [n for n, k in zip(self.names, which.tolist()) if k]
            self.state = self.state[:, which]

    def predict(self) -> np.ndarray:
        """Moves all tracks on by a frame; their boxes."""
        s = self.state
        s[6, s[6] + s[2] <= 0] = 0.0
        s[:3] += s[self.VELOCITY]
        s[self.SPREAD] += 2 * s[self.BOTH] + s[self.SPREAD_VELOCITY] + GROWTH
        s[self.BOTH] += s[self.SPREAD_VELOCITY]
        s[self.SPREAD_VELOCITY] += GROWTH_VELOCITY[:, None]
        s[self.ASPECT] += GROWTH
        s[self.STREAK, s[self.SINCE] > 0] = 0
        s[self.SINCE] += 1
        boxes = corners(s[self.POSITION].T)
        whole = np.isfinite(boxes).all(axis=1)
        self.keep(whole)
        return boxes[whole]

    def update(self, which: list[int], z: np.ndarray) -> None:
        s = self.state[:, which]
        off = z.T - s[self.POSITION]
        sure = s[self.SPREAD] + MEASURED[:3, None]
        gain, gain_velocity = s[self.SPREAD] / sure, s[self.BOTH] / sure
        s[:3] += gain * off[:3]
        s[self.VELOCITY] += gain_velocity * off[:3]
        s[self.SPREAD_VELOCITY] -= gain_velocity * s[self.BOTH]
        s[self.BOTH] *= 1 - gain
        s[self.SPREAD] *= 1 - gain
        gain = s[self.ASPECT] / (s[self.ASPECT] + MEASURED[3])
        s[3] += gain * off[3]
        s[self.ASPECT] *= 1 - gain
        s[self.SINCE] = 0
        s[self.STREAK] += 1
        self.state[:, which] = s

    def open(self, names: list[tuple[int, int]], z: np.ndarray) -> None:
        new = np.zeros((self.NUMBERS, len(names)))
        new[self.POSITION] = z.T
        new[self.SPREAD], new[self.SPREAD_VELOCITY], new[self.ASPECT] = FIRST, FIRST_VELOCITY, FIRST
        self.names += names
        self.state = np.concatenate([self.state, new], axis=1)

    def step(self, count: int, frame: int, seqs: list[int], boxes: np.ndarray) -> tuple[list, list, list]:
        """Names of the tracks of the boxes of the count-th frame, whether they are reported, filtered boxes."""
        pairs = assigned(self.predict(), boxes, self.min_overlap)
        z = measured(boxes)
        row = {b: t for t, b in pairs}
        if pairs:
            self.update([t for t, _ in pairs], z[[b for _, b in pairs]])
        free = [b for b in range(len(boxes)) if b not in row]
        if free:
            row.update((b, len(self.names) + k) for k, b in enumerate(free))
            self.open([(frame, seqs[b]) for b in free], z[free])
        held = [row[b] for b in range(len(boxes))]
        found = corners(self.state[self.POSITION, held].T).tolist()
        reported = ((self.state[self.STREAK, held] >= self.min_hits) | (count <= self.min_hits)).tolist()
        names = [self.names[t] for t in held]
        self.keep(self.state[self.SINCE] <= self.max_age)
        return names, reported, found

    def rows(self) -> Iterator[tuple]:
        """(first frame, first seq, numbers) of every open track."""
        for (frame, seq), numbers in zip(self.names, self.state.T.tolist()):
            yield frame, seq, numbers

    def resume(self, names: list[tuple[int, int]], numbers: list[np.ndarray]) -> None:
        self.names, self.state = names, np.array(numbers).T.copy()


def _walked(max_age: int, min_hits: int, min_overlap: float):
    """Task over rows of videos in order: open tracks (f null), then boxes by frame."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["video", "f", "frame_number", "seq", "first_frame", "first_seq", "reported", "numbers"]
        types, out = [], [[] for _ in names]
        video, tracks, waiting, frame, held = None, None, [], None, []

        def add(*rows):
            for column, values in zip(out, rows):
                column.extend(values)

        def finish_frame():
            nonlocal held, waiting
            if waiting:
                tracks.resume([w[0] for w in waiting], [w[1] for w in waiting])
                waiting = []
            if held:
                f, number = frame
                seqs = [s for part, _ in held for s in part]
                found, reported, boxes = tracks.step(f, number, seqs, np.concatenate([b for _, b in held]))
                n = len(seqs)
                add([video] * n, [f] * n, [number] * n, seqs, [a for a, _ in found], [b for _, b in found], reported, boxes)
                held = []

        def finish_video():
            if tracks is not None:
                finish_frame()
                for first, first_seq, numbers in tracks.rows():
                    add([video], [None], [None], [None], [first], [first_seq], [None], [numbers])

        def record():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

        for batch in batches:
            types = [batch.schema.field(0).type, *[pa.int64()] * 5, pa.bool_(), pa.list_(pa.float64())]
            videos, fs, numbers, seqs, firsts, first_seqs = (c.to_pylist() for c in batch.columns[:-1])
            cuts, values = batch.columns[-1].offsets.to_pylist(), batch.columns[-1].values.to_numpy()
            at, end = 0, len(fs)
            while at < end:
                v, f = videos[at], fs[at]
                if tracks is None or v != video:
                    finish_video()
                    video, tracks, waiting, frame, held = v, Tracks(max_age, min_hits, min_overlap), [], None, []
                to = at + 1
                if f is None:
                    waiting.append(((firsts[at], first_seqs[at]), values[cuts[at]:cuts[to]]))
                else:
                    while to < end and fs[to] == f and videos[to] == v:
                        to += 1
                    if frame != (f, numbers[at]):
                        finish_frame()
                        frame = (f, numbers[at])
                    held.append((seqs[at:to], values[cuts[at]:cuts[to]].reshape(-1, len(BOX))))
                at = to
            if len(out[0]) > 20_000:
                yield record()
                out = [[] for _ in names]
        finish_video()
        if out[0]:
            yield record()

    return walk


def _places(rows: DataFrame, tasks: int) -> DataFrame:
    """video, place (0..): the longest videos, at most one for each task, which they do not share with one another."""
    longest = rows.groupBy("video").count().orderBy(F.desc("count"), "video").limit(tasks).collect()
    kind = rows.schema["video"].dataType.simpleString()
    return rows.sparkSession.createDataFrame([(r["video"], k) for k, r in enumerate(longest)], f"video {kind}, place int")


def tracked(boxes: DataFrame, video: str = "video_id", seq: str = "seq", max_age: int = 7, min_hits: int = 1,
            min_overlap: float = 0.1, frames: int = FRAMES, block: Column | None = None) -> DataFrame:
    """Each box with its track: video, frame_number, seq, first_frame, first_seq (the box that opened the track),
    reported, and the filtered box fx1, fy1, fx2, fy2.

    `boxes` has one row per box with a number unique in its frame; coordinates are numbers. A box is reported when its
    track has had `min_hits` hits in a row after the first box, or in the first `min_hits` frames of a video.
    Boxes without area open a track that nothing joins. One written round per block of the longest video.
    """
    spark = boxes.sparkSession
    rows = cut_lineage(boxes.select(F.col(video).alias("video"), F.col("frame_number").cast("long").alias("frame_number"),
                                    F.col(seq).cast("long").alias("seq"), F.array(*[F.col(c).cast("double") for c in BOX]).alias("numbers")))
    counted = with_position(rows.select("video", "frame_number").distinct(), ["video"], ["frame_number"], block, out="f", rows_out="_n")
    folder = f"{checkpoint_dir(spark)}/tracked-{uuid.uuid4().hex}"
    (rows.join(counted.drop("_n"), ["video", "frame_number"])
     .withColumn("part", F.floor((F.col("f") - 1) / F.lit(frames)).cast("int")).repartition(F.col("part"), F.col("video"))
     .write.partitionBy("part").parquet(folder))  # a round reads its part only
    none = F.lit(None).cast("long")
    kind = rows.schema["video"].dataType.simpleString()
    stored = spark.read.schema(f"video {kind}, frame_number long, seq long, numbers array<double>, f long, part int").parquet(folder)
    parts = stored.agg(F.max("part")).first()[0]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by work: the rows are small, and would be put together by size
    places = F.broadcast(_places(stored, tasks))
    task = F.coalesce("place", F.pmod(F.hash("video"), F.lit(tasks)))
    schema = (f"video {kind}, f long, frame_number long, seq long, first_frame long, first_seq long, reported boolean, "
              "numbers array<double>")
    results, going = [], None
    for part in range(0 if parts is None else parts + 1):
        now = stored.filter(F.col("part") == part).select("video", "f", "frame_number", "seq", none.alias("first_frame"),
                                                          none.alias("first_seq"), "numbers")
        if going is not None:  # only videos that have a block here go on
            now = now.unionByName(going.join(now.select("video").distinct(), "video", "left_semi"))
        dealt = now.join(places, "video", "left").repartitionById(tasks, task).drop("place")
        walked = cut_lineage(dealt.sortWithinPartitions("video", F.asc_nulls_first("f"), "seq", "first_frame", "first_seq")
                             .mapInArrow(_walked(max_age, min_hits, min_overlap), schema))
        results.append(walked.filter("f IS NOT NULL"))
        going = walked.filter("f IS NULL").select("video", "f", "frame_number", "seq", "first_frame", "first_seq", "numbers")
    if not results:
        results = [spark.createDataFrame([], schema)]
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found.select(F.col("video").alias(video), "frame_number", "seq", "first_frame", "first_seq", "reported",
                        *[F.col("numbers")[k].alias(f"f{c}") for k, c in enumerate(BOX)])
