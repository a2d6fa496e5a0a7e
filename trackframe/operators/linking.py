"""Tracks from detections by linking overlapping boxes of nearby frames.

This replaces a per-video filter-and-assignment tracker: two boxes are linked when each is the
other's best partner (fewest frames apart, then largest overlap). Frames without boxes do not
count. Links only go forward, so chains have a beginning, whose box names the track.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trackframe.functions import geometry as g
from trackframe.functions.ordering import with_position
from trackframe.session import cut_lineage

BOX = ("x1", "y1", "x2", "y2")
FRAMES = 1024           # frames of a block that one task links
BLOCK_BOXES = 200_000   # boxes of a block that one task takes
PAIRS = 1_000_000       # pairs of boxes that a task holds at once


def numbered_frames(boxes: DataFrame, video: str = "video_id", block: Column | None = None) -> DataFrame:
    """Frames that have boxes, with their number `f` among these and their boxes `n`; written once."""
    frames = boxes.groupBy(video, "frame_number").agg(F.count("*").alias("n"))
    return cut_lineage(with_position(frames, [video], ["frame_number"], block, out="f", rows_out="_n").drop("_n"))


def box_links(numbered: DataFrame, video: str = "video_id", min_overlap: float = 0.1, max_gap: int = 7,
              cell: int = 64) -> DataFrame:
    """Mutually best links (video, f, seq) -> (video, f2, seq2)."""
    b = numbered.select(video, "f", "seq", "box")

    def span(low, high):
        return F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))

    cells = b.withColumn("cx", span("box.x1", "box.x2")).withColumn("cy", span("box.y1", "box.y2"))
    earlier = cells.withColumn("gap", F.explode(F.sequence(F.lit(1), F.lit(max_gap)))).select(
        video, (F.col("f") + F.col("gap")).alias("f2"), "gap", "f", "seq", F.col("box").alias("a"), "cx", "cy")
    later = cells.select(video, F.col("f").alias("f2"), F.col("seq").alias("seq2"), F.col("box").alias("b"), "cx", "cy")
    home = ((F.floor(F.greatest("a.x1", "b.x1") / cell) == F.col("cx"))
            & (F.floor(F.greatest("a.y1", "b.y1") / cell) == F.col("cy")))
    overlap = g.overlap_ratio("a", "b")
    near = (earlier.join(later, [video, "f2", "cx", "cy"]).filter(home & (overlap >= min_overlap))
            .select(video, "f", "seq", "f2", "seq2", "gap", overlap.alias("overlap")))
    rank = [F.col("gap"), (-F.col("overlap")).alias("o")]
    # both ends choose in one pass: a pair counts once for its earlier and once for its later box
    ends = F.array(
        F.struct(F.lit(0).alias("side"), F.col("f").alias("kf"), F.col("seq").alias("kseq"),
                 F.struct(*rank, F.col("seq2").alias("s"), F.col("f2").alias("t")).alias("m")),
        F.struct(F.lit(1).alias("side"), F.col("f2").alias("kf"), F.col("seq2").alias("kseq"),
                 F.struct(*rank, F.col("seq").alias("s"), F.col("f").alias("t")).alias("m")))
    best = cut_lineage(near.select(video, F.explode(ends).alias("e")).select(video, "e.*")
                       .groupBy(video, "side", "kf", "kseq").agg(F.min("m").alias("m")))
    ahead = best.filter(F.col("side") == 0).select(
        video, F.col("kf").alias("f"), F.col("kseq").alias("seq"), F.col("m.t").alias("f2"), F.col("m.s").alias("seq2"))
    back = best.filter(F.col("side") == 1).select(
        video, F.col("m.t").alias("f"), F.col("m.s").alias("seq"), F.col("kf").alias("f2"), F.col("kseq").alias("seq2"))
    return ahead.join(back, [video, "f", "seq", "f2", "seq2"])


def _joined_tracks(nodes: DataFrame, video: str, min_overlap: float, max_gap: int) -> DataFrame:
    """Tracks of videos of any density, by joins. `nodes` has video, frame_number, f, seq, box.

    Every round lets a box point to what its present pointer points to, so chains of n boxes
    need about log2(n) written rounds.
    """
    nodes = cut_lineage(nodes)
    links = box_links(nodes, video, min_overlap, max_gap).select(
        video, F.col("f2").alias("f"), F.col("seq2").alias("seq"), F.col("f").alias("pf"), F.col("seq").alias("pseq"))
    state = cut_lineage(nodes.join(links, [video, "f", "seq"], "left").select(
        video, "frame_number", "f", "seq", F.coalesce("pf", "f").alias("rf"), F.coalesce("pseq", "seq").alias("rseq")))
    changed = True
    while changed:
        up = state.select(video, F.col("f").alias("rf"), F.col("seq").alias("rseq"),
                          F.col("rf").alias("gf"), F.col("rseq").alias("gseq"))
        state = cut_lineage(state.join(up, [video, "rf", "rseq"]).select(
            video, "frame_number", "f", "seq", F.col("gf").alias("rf"), F.col("gseq").alias("rseq"),
            ((F.col("gf") != F.col("rf")) | (F.col("gseq") != F.col("rseq"))).alias("moved")))
        changed = not state.filter("moved").isEmpty()
        state = state.drop("moved")
    first = state.filter((F.col("f") == F.col("rf")) & (F.col("seq") == F.col("rseq"))).select(
        video, "rf", "rseq", F.col("frame_number").alias("first_frame"))
    return state.join(first, [video, "rf", "rseq"]).select(
        video, "frame_number", F.col("seq"), "first_frame", F.col("rseq").alias("first_seq"))


def _best(f: np.ndarray, box: np.ndarray, min_overlap: float, gaps: range) -> np.ndarray:
    """For boxes in order of frame and number: the place of the best partner that lies the first of `gaps` away at
    which there is one, -1 without any."""
    x1, y1, x2, y2 = box
    area = (x2 - x1) * (y2 - y1)
    found = np.full(len(f), -1)
    for gap in gaps:
        todo = np.flatnonzero(found < 0)
        low, high = np.searchsorted(f, f[todo] + gap, "left"), np.searchsorted(f, f[todo] + gap, "right")
        upto = np.cumsum(high - low)
        at = 0
        while at < len(todo):  # some boxes with all of their partners at once
            done = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
            n = (high - low)[at:to]
            i = np.repeat(todo[at:to], n)
            j = np.arange(len(i)) + np.repeat(low[at:to] - (upto[at:to] - n - done), n)
            w = np.minimum(x2[i], x2[j]) - np.maximum(x1[i], x1[j])
            h = np.minimum(y2[i], y2[j]) - np.maximum(y1[i], y1[j])
            meet = np.flatnonzero((w > 0) & (h > 0))
            i, j, shared = i[meet], j[meet], w[meet] * h[meet]
            overlap = shared / (area[i] + area[j] - shared)
            near = overlap >= min_overlap
            i, j, overlap = i[near], j[near], overlap[near]
            order = np.lexsort((j, -overlap, i))
            own, first = np.unique(i[order], return_index=True)
            found[own] = j[order][first]
            at = to
    return found


def _linked(min_overlap: float, max_gap: int, frames: int) -> Callable[[pa.Table], pa.Table]:
    """Task over one block of frames and the `max_gap` frames on either side: its boxes with the first box of their
    chain inside the block; that box with the one before it, if another block holds one."""

    def link(table: pa.Table) -> pa.Table:
        f, seq = (table.column(c).to_numpy() for c in ("f", "seq"))
        order = np.lexsort((seq, f))
        table, f, seq = table.take(order), f[order], seq[order]
        box = np.array([table.column(c).to_numpy() for c in BOX])  # null: NaN, overlaps nothing
        ahead = _best(f, box, min_overlap, range(1, max_gap + 1))
        back = _best(f, box, min_overlap, range(-1, -max_gap - 1, -1))
        before = np.where((back >= 0) & (ahead[back] == np.arange(len(f))), back, -1)
        mine = (f - 1) // frames == table.column("part").to_numpy()
        root = np.where((before >= 0) & mine[before], before, np.arange(len(f)))
        while (root[root] != root).any():
            root = root[root]
        number = table.column("frame_number").to_numpy()
        outside = mine & (root == np.arange(len(f))) & (before >= 0)
        columns = [table.column(0), pa.array(number), pa.array(f), pa.array(seq), pa.array(number[root]), pa.array(f[root]),
                   pa.array(seq[root]), pa.array(f[before], mask=~outside), pa.array(seq[before], mask=~outside)]
        return pa.Table.from_arrays(columns, names=[table.column_names[0], *PLACED]).filter(pa.array(mine))

    return link


PLACED = ("frame_number", "f", "seq", "first_frame", "rf", "rseq", "pf", "pseq")


def _block_tracks(nodes: DataFrame, video: str, min_overlap: float, max_gap: int, frames: int) -> DataFrame:
    """Tracks from links inside blocks of frames; only chains that go on over a border are followed in rounds,
    about log2(blocks) of them over one row per such chain and block."""
    kind = nodes.schema[video].dataType.simpleString()
    part = F.explode(F.sequence(F.floor(F.greatest(F.col("f") - 1 - max_gap, F.lit(0)) / frames),
                                F.floor((F.col("f") - 1 + max_gap) / frames))).alias("part")
    near = nodes.select(video, F.col("frame_number").cast("long").alias("frame_number"), F.col("f").cast("long").alias("f"),
                        F.col("seq").cast("long").alias("seq"), *[F.col(f"box.{c}").cast("double").alias(c) for c in BOX], part)
    placed = cut_lineage(near.groupBy(video, "part").applyInArrow(
        _linked(min_overlap, max_gap, frames), f"`{video}` {kind}, " + ", ".join(f"{c} long" for c in PLACED)))
    heads = placed.filter("pf IS NOT NULL").select(video, "rf", "rseq", F.col("pf").alias("f"), F.col("pseq").alias("seq"))
    last = placed.filter((F.col("f") - 1) % frames >= frames - max_gap).select(
        video, "f", "seq", "first_frame", F.col("rf").alias("gf"), F.col("rseq").alias("gseq"))
    state = cut_lineage(heads.join(last, [video, "f", "seq"]).drop("f", "seq"))
    changed = True
    while changed:
        up = state.select(video, F.col("rf").alias("gf"), F.col("rseq").alias("gseq"), F.col("first_frame").alias("_frame"),
                          F.col("gf").alias("_f"), F.col("gseq").alias("_seq"))
        on = F.col("_f").isNotNull()
        state = cut_lineage(state.join(up, [video, "gf", "gseq"], "left").select(
            video, "rf", "rseq", F.coalesce("_frame", "first_frame").alias("first_frame"), F.coalesce("_f", "gf").alias("gf"),
            F.coalesce("_seq", "gseq").alias("gseq"), on.alias("moved")))
        changed = not state.filter("moved").isEmpty()
        state = state.drop("moved")
    whole = state.withColumnRenamed("first_frame", "_frame")
    return placed.join(whole, [video, "rf", "rseq"], "left").select(
        video, "frame_number", "seq", F.coalesce("_frame", "first_frame").alias("first_frame"),
        F.coalesce("gseq", "rseq").alias("first_seq"))


def linked_tracks(boxes: DataFrame, video: str = "video_id", seq: str = "seq", min_overlap: float = 0.1,
                  max_gap: int = 7, min_hits: int = 1, block: Column | None = None, frames: int = FRAMES,
                  block_boxes: int = BLOCK_BOXES) -> DataFrame:
    """Each box with the first box (frame and number) of its track. `boxes` has one row per
    box with a number unique in its frame.

    Blocks of `frames` frames are linked inside tasks; videos with more than `block_boxes` boxes in a block are
    linked by joins with the same result.
    """
    kinds = dict(boxes.dtypes)
    boxes = cut_lineage(boxes.select(video, "frame_number", F.col(seq).alias("seq"), F.struct(*BOX).alias("box")))
    numbered = numbered_frames(boxes, video, block)
    frames = max(frames, max_gap)
    large = numbered.groupBy(video, F.floor((F.col("f") - 1) / frames)).agg(F.sum("n").alias("n")).filter(
        F.col("n") > block_boxes).select(video).distinct()
    nodes = boxes.join(numbered.drop("n"), [video, "frame_number"])
    if large.isEmpty():
        tracks = _block_tracks(nodes, video, min_overlap, max_gap, frames)
    else:
        tracks = _block_tracks(nodes.join(large, video, "left_anti"), video, min_overlap, max_gap, frames).unionByName(
            _joined_tracks(nodes.join(large, video, "left_semi"), video, min_overlap, max_gap))
    tracks = tracks.select(video, *[F.col(c).cast(kinds[k]).alias(c) for c, k in (
        ("frame_number", "frame_number"), ("seq", seq), ("first_frame", "frame_number"), ("first_seq", seq))])
    if min_hits > 1:
        hits = (tracks.groupBy(video, "first_frame", "first_seq").agg(F.count("*").alias("_h"))
                .filter(F.col("_h") >= min_hits).drop("_h"))
        tracks = tracks.join(hits, [video, "first_frame", "first_seq"], "left_semi")
    return tracks
