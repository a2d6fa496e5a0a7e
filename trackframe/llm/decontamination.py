"""Benchmark passages in documents, by SimHash of item-sized windows.

Windows have the number of words of some benchmark item. Their SimHash and an item's are joined through a
multi-index: both are cut into BLOCKS parts, and an item is filed under every value within BALL bits of each of
its parts, so any two fingerprints within RADIUS = BLOCKS * (BALL + 1) - 1 bits meet in at least one part. Pairs
within the radius are verified by the weighted similarity of their multisets of 5-word runs.

Only windows that could pass are fingerprinted: runs of items of the window's size must hold at least 0.8 of the
window's weight, as no more can be shared. A window may start with a run of some item, for moving it past a run
of none never lowers the similarity: such a run has the greatest weight.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackframe.llm.licenses import runs_of
from trackframe.llm.texts import text_of
from trackframe.session import cut_lineage

K = 5
SIMILAR = 0.8
BLOCKS, BITS, BALL = 4, 16, 3
RADIUS = BLOCKS * (BALL + 1) - 1
BROADCAST_ROWS = 2_000_000    # of (run, size), 24 bytes each
BROADCAST_SPANS = 1_000_000  # of (size, start), 16 bytes each
COUNTED = 32_767              # words that counters of 16 bits in a signed long can take
SCALE = 1_000_000             # of weights in whole numbers


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _row_key(id_column: str, text: str) -> tuple[Column, Column]:
    """What tells rows apart: the id and the hash of the text."""
    return F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 62))), F.xxhash64(text_of(text))


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    own_id, own_key = _row_key(id_column, text)
    return docs.select(own_id.alias("_id"), own_key.alias("_key"), F.col(id_column).cast("long").alias("doc_id"),
                       text_of(text).alias("text"))


def fingerprint(rows: DataFrame, by: list[str], words: str = "words", longest: int = COUNTED) -> DataFrame:
    """by and the 64-bit SimHash of the words. A long counts several bits: four, or two where `longest`, the most
    words of a row, asks for counters of 32 bits."""
    width = 16 if longest <= COUNTED else 32
    per = 64 // width
    ones_of = F.lit(sum(1 << width * part for part in range(per)))
    each = rows.select(*by, F.explode(words).alias("word")).withColumn("h", F.xxhash64("word"))
    counted = each.groupBy(*by).agg(F.count("*").alias("_n"), *[
        F.sum(F.shiftrightunsigned("h", j).bitwiseAND(ones_of)).alias(f"_c{j}") for j in range(width)])
    value = F.lit(0).cast("long")
    for j in range(width):
        for part in range(per):
            ones = F.shiftrightunsigned(f"_c{j}", width * part).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            value = value.bitwiseOR(F.when(2 * ones > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), j + width * part))
                                    .otherwise(F.lit(0).cast("long")))
    return counted.select(*by, value.alias("mark"))


def _parts(mark: Column) -> list[Column]:
    return [F.shiftrightunsigned(mark, BITS * b).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")) for b in range(BLOCKS)]


def _ball() -> list[int]:
    """All values of a part with at most BALL bits set."""
    return [sum(1 << i for i in c) for n in range(BALL + 1) for c in combinations(range(BITS), n)]


def _bag(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, run, c: how often each run of K words stands in the words (all words together in fewer)."""
    runs = rows.select(*by, F.explode(runs_of(F.col("words"), K)).alias("run")).unionByName(
        rows.filter((F.size("words") < K) & (F.size("words") > 0)).select(*by, F.xxhash64("words").alias("run")))
    return runs.groupBy(*by, "run").agg(F.count("*").alias("c"))


def _promising(hits: DataFrame, most: float, similar: float) -> DataFrame:
    """_id, _key, m, start of the windows of m words in which runs of items of m words weigh enough.

    hits: _id, _key, n (words of the row), place, run, w (its weight) and ms (sizes of the items that hold it), for
    every run of an item. A window with r runs needs known >= similar * (known + other). With all other runs at
    the greatest weight, this is: the sum over its hits of (w where known) + similar * (most - w), which is never
    negative, is at least similar * most * r. The sums are differences of running sums, so work is linear.
    """
    row = ["_id", "_key"]
    per_row = hits.select(*row, F.explode("ms").alias("m")).groupBy(*row).agg(F.collect_set("m").alias("all_ms"))
    each = hits.join(per_row, row).select(*row, "n", "place", "w", "ms", F.explode("all_ms").alias("m"))
    known = F.when(F.array_contains("ms", F.col("m")), F.col("w")).otherwise(0.0)
    gain = F.ceil((known + similar * (most - F.col("w"))) * SCALE).cast("long")
    each = each.select(*row, "n", "m", F.col("place").cast("long").alias("place"), gain.alias("gain"))
    r = F.greatest(F.least("n", "m") - K + 1, F.lit(1)).cast("long")
    last = F.greatest(F.col("n") - F.col("m"), F.lit(0)).cast("long")

    def event(at, after, value, start, sign):
        return F.struct(at.cast("long").alias("at"), F.lit(after).alias("after"), value.cast("long").alias("gain"),
                        start.cast("long").alias("start"), F.lit(sign).alias("sign"))

    def ends_of(start):
        return [event(start, 0, F.lit(0), start, -1), event(start + r, 0, F.lit(0), start, 1)]

    place = F.col("place")
    counted = event(place, 1, F.col("gain"), F.lit(None), 0)
    events = each.select(*row, "n", "m", F.explode(F.when(place < last, F.array(counted, *ends_of(place)))
                                                   .otherwise(F.array(counted))).alias("e")).unionByName(
        each.select(*row, "n", "m").distinct().select(*row, "n", "m", F.explode(F.array(*ends_of(last))).alias("e")))
    upto = Window.partitionBy(*row, "n", "m").orderBy("e.at", "e.after").rowsBetween(Window.unboundedPreceding, 0)
    sums = (events.withColumn("upto", F.sum("e.gain").over(upto)).filter("e.start is not null")
            .groupBy(*row, "n", "m", F.col("e.start").alias("start")).agg(F.sum(F.col("e.sign") * F.col("upto")).alias("got")))
    need = F.floor(similar * most * r * SCALE * (1 - 1e-9)).cast("long")
    return sums.filter(F.col("got") >= need).select(*row, "m", F.col("start").cast("int").alias("start"))


def _leaks(docs: DataFrame, benchmark: DataFrame, similar: float, id_column: str, text: str, item_column: str) -> DataFrame:
    """The rows of `leaks`, with the _id and _key of theirs."""
    items = benchmark.select(F.col(item_column).alias("item_id"), words_of(text_of()).alias("words")).filter(F.size("words") > 0)
    items = cut_lineage(items.withColumn("m", F.size("words")).dropDuplicates(["item_id", "words"])
                        .withColumn("item", F.xxhash64("item_id", "words")))
    n_items = items.count()
    bag = cut_lineage(_bag(items, ["item", "m"]))
    weights = bag.groupBy("run").agg((1.0 + F.log(F.lit(float(max(n_items, 1))) / F.count("*"))).alias("w"))
    most = 1.0 + math.log(max(n_items, 1))
    sizes = sorted(r["m"] for r in items.select("m").distinct().collect())  # at most the words of the longest item
    source = _keyed(docs, id_column, text)

    # runs of documents that occur in items
    known = bag.groupBy("run").agg(F.collect_set("m").alias("ms")).join(weights, "run")
    few_runs = bag.select("run", "m").distinct().count() <= BROADCAST_ROWS

    def hits_of(k, wanted):
        runs = source.withColumn("words", words_of(F.col("text"))).select("_id", "_key", F.size("words").alias("n"),
                                                                          F.posexplode(runs_of(F.col("words"), k)).alias("place", "run"))
        return runs.join(F.broadcast(wanted) if few_runs else wanted, "run")

    spans = _promising(cut_lineage(hits_of(K, known)), most, similar)
    for k in sorted(m for m in sizes if m < K):  # items of fewer words are one run of their own length
        of_size = bag.filter(F.col("m") == k).select("run", "m").distinct()
        spans = spans.unionByName(hits_of(k, of_size).select("_id", "_key", "m", F.col("place").alias("start")))
    spans = cut_lineage(spans)

    # words of the windows
    few = spans.count() <= BROADCAST_SPANS
    lists = spans.groupBy("_id", "_key").agg(F.collect_list(F.struct("m", "start")).alias("spans"))
    held = source.join(F.broadcast(lists) if few else lists, ["_id", "_key"]).withColumn("words", words_of(F.col("text")))
    windows = cut_lineage(held.select("_id", "_key", "doc_id", "words", F.explode("spans").alias("s")).select(
        "_id", "_key", "doc_id", "s.m", "s.start", F.slice("words", F.col("s.start") + 1, F.col("s.m")).alias("words"))
        .dropDuplicates(["_id", "_key", "m", "start"]))

    # fingerprints that lie within the radius
    by = ["_id", "_key", "m", "start"]
    longest = max(sizes, default=0)
    marks = cut_lineage(fingerprint(windows, by, longest=longest))
    item_marks = cut_lineage(fingerprint(items, ["item", "m"], longest=longest))
    filed = item_marks.select("item", "m", F.col("mark").alias("item_mark"), F.posexplode(F.array(*_parts(F.col("mark")))).alias("part", "v"))
    filed = filed.select("item", "m", "item_mark", "part", F.explode(F.transform(
        F.lit(_ball()), lambda x: x.cast("long").bitwiseXOR(F.col("v")))).alias("value"))
    met = (marks.select(*by, "mark", F.posexplode(F.array(*_parts(F.col("mark")))).alias("part", "value"))
           .join(filed, ["m", "part", "value"]).select(*by, "item", F.bit_count(
               F.col("mark").bitwiseXOR(F.col("item_mark"))).alias("distance")).filter(F.col("distance") <= RADIUS).distinct())

    # exact similarity
    pairs = cut_lineage(met)
    of_window = _bag(windows.join(pairs.select(*by).distinct(), by, "left_semi"), by).join(weights, "run", "left")
    of_window = cut_lineage(of_window.withColumn("w", F.coalesce("w", F.lit(most))))
    of_item = bag.join(weights, "run").select("item", "run", F.col("c").alias("c_item"), "w")
    shared = (pairs.join(of_window, by).join(of_item.drop("w"), ["item", "run"])
              .groupBy(*by, "item", "distance").agg(F.sum(F.least("c", "c_item") * F.col("w")).alias("both")))
    window_weight = of_window.groupBy(*by).agg(F.sum(F.col("c") * F.col("w")).alias("ww"))
    item_weight = of_item.groupBy("item").agg(F.sum(F.col("c_item") * F.col("w")).alias("wi"))
    likeness = F.round(F.col("both") / (F.col("ww") + F.col("wi") - F.col("both")), 9)
    near = (shared.join(window_weight, by).join(item_weight, "item").withColumn("similarity", likeness)
            .filter(F.col("similarity") >= similar).join(items.select("item", "item_id"), "item")
            .join(windows.select(*by, "doc_id", F.size("words").alias("n_words")), by))
    best = Window.partitionBy("_id", "_key", "item").orderBy(F.desc("similarity"), "start")
    return near.withColumn("_best", F.row_number().over(best)).filter("_best = 1").select(
        "_id", "_key", "doc_id", "item_id", "start", "n_words", "distance", "similarity")


def leaks(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, id_column: str = "doc_id",
          text: str = "text", item_column: str = "item_id") -> DataFrame:
    """doc_id, item_id, start (word), n_words, distance, similarity: the best window of every document for every
    item it holds a near copy of.

    A run's weight is 1 + ln(items / items that hold it), most for runs of no item. Similarity is the weight
    shared by both multisets over the weight of either. Documents shorter than an item are compared whole.
    Null or empty texts and items without words give nothing; rows that repeat id and text count once, a null id
    is reported as null.
    """
    return _leaks(docs, benchmark, similar, id_column, text, item_column).drop("_id", "_key")


def without_leaks(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, id_column: str = "doc_id",
                  text: str = "text", item_column: str = "item_id") -> DataFrame:
    """Rows whose own text holds no near copy of an item, whatever other rows of the same id, or without id, hold."""
    gone = _leaks(docs, benchmark, similar, id_column, text, item_column).select(
        F.col("_id").alias("_gone"), F.col("_key").alias("_gone_key")).distinct()
    own_id, own_key = _row_key(id_column, text)
    return docs.join(gone, (own_id == F.col("_gone")) & (own_key == F.col("_gone_key")), "left_anti")
