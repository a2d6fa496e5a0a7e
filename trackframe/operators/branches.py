"""One shortest path for every junction and endpoint of a trail graph.

Paths are never held in the state of the search: it has one row per source and node with the length and the node
before. Afterwards the nodes of all paths are found at once, each by its distance from the end: pointers to the
node 1, 2, 4, ... places before are made by joining them with themselves, and a place is reached by the bits of its
distance. The longest path needs as many joins as its length has bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trackframe.operators.trails import NX, SITE, cell_graph, node_degrees
from trackframe.session import cut_lineage


def shortest_steps(links: DataFrame, sources: DataFrame, keys=SITE, hops_per_round: int = 8) -> DataFrame:
    """keys, source, node, length (edges from the source) and before (the smallest node one edge nearer; null at the
    source), for every node that a source reaches. `links` has keys, node, other; `sources` keys, source."""
    keys = list(keys)
    lists = cut_lineage(links.groupBy(*keys, "node").agg(F.array_sort(F.collect_set("other")).alias("others")))
    none = F.lit(None).cast("int")
    state = sources.select(*keys, "source", F.col("source").alias("node"), F.lit(0).alias("length"), none.alias("before"))
    last = None
    while True:
        for _ in range(hops_per_round):
            stay = F.struct("node", "length", "before")
            go = F.transform(F.coalesce("others", F.array().cast("array<int>")), lambda o: F.struct(
                o.alias("node"), (F.col("length") + 1).alias("length"), F.col("node").alias("before")))
            state = (state.join(lists, [*keys, "node"], "left")
                     .select(*keys, "source", F.explode(F.concat(F.array(stay), go)).alias("s"))
                     .groupBy(*keys, "source", F.col("s.node").alias("node"))
                     .agg(F.min(F.struct("s.length", "s.before")).alias("m")).select(*keys, "source", "node", "m.*"))
        state = cut_lineage(state)
        # a hop that changes nothing is followed by none that does: every length and node before only falls
        now = tuple(state.agg(F.count("*"), F.sum("length"), F.sum("before")).first())
        if now == last:
            return state
        last = now


def unique_branches(cells: DataFrame, junctions: DataFrame, keys=SITE, graph: DataFrame | None = None,
                    ends: DataFrame | None = None) -> DataFrame:
    """keys, rank (of the junction), node (the endpoint), seq from 0 at the junction, x_bin, y_bin.

    One path for every junction and endpoint that it reaches; of equally short ones the one that, from the end, goes
    by the smallest nodes. Paths go over the neighbouring cells of `cells`, or over `graph` (keys, node, other), and
    end in cells with one neighbour, or in `ends` (keys, node).
    """
    keys = list(keys)
    links = cell_graph(cells, keys) if graph is None else graph
    ends = node_degrees(cells, keys).filter("is_endpoint").select(*keys, "node") if ends is None else ends
    source = (F.col("y_bin") * NX + F.col("x_bin")).cast("int")
    known = cut_lineage(junctions.select(*keys, "rank", source.alias("source")))
    steps = shortest_steps(links, known.select(*keys, "source").distinct(), keys)
    found = cut_lineage(known.join(steps, [*keys, "source"]).join(ends.distinct(), [*keys, "node"])
                        .select(*keys, "rank", "source", "node", "length"))
    longest = found.agg(F.max("length")).first()[0] or 0
    at = found.withColumn("seq", F.explode(F.sequence(F.lit(0), "length"))).withColumn("far", F.col("length") - F.col("seq"))
    at = at.withColumn("here", F.col("node"))
    jump = steps.filter("before IS NOT NULL").select(*keys, "source", F.col("node").alias("here"), F.col("before").alias("there"))
    for bit in range(int(longest).bit_length()):
        if bit:
            on = jump.select(*keys, "source", F.col("here").alias("there"), F.col("there").alias("beyond"))
            jump = cut_lineage(jump.join(on, [*keys, "source", "there"]).select(*keys, "source", "here", F.col("beyond").alias("there")))
        far = F.shiftright("far", bit).bitwiseAND(1) == 1
        at = at.join(jump, [*keys, "source", "here"], "left").withColumn("here", F.when(far, F.col("there")).otherwise(F.col("here"))).drop("there")
    return at.select(*keys, "rank", "node", "seq", (F.col("here") % NX).alias("x_bin"), F.floor(F.col("here") / NX).cast("int").alias("y_bin"))
