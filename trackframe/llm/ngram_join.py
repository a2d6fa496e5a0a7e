"""Exact Jaccard self-join of documents on word shingles, filtered under several token orders.

Two sets with similarity t or more share a token among the first n - ceil(t n) + 1 tokens of each, whatever
order all tokens are put in. The first order is indexed: documents meet where their prefixes under it meet, and at
the first token they share, what follows it in the shorter rest must still be enough tokens for a link.
A pair that met is kept only if what its sets can share by their sketches is enough, if its prefixes meet under the
other orders too, and if the whole sets link. All orders put tokens that tasks saw often last (by powers of two) and
are random otherwise, each in its own way; how well the tasks' counts hit the true ones changes cost, never results.

Equal sets are one node throughout. A token met by few documents emits their pairs. Documents that meet in
crowded tokens meet again in a further round, under an order in which those tokens stand later, as long as that
leaves fewer of them; a link shares a prefix token under any order, so no round loses one. What is still crowded
then (true copies, mostly) forms families; a family is cut into blocks of similar set size, and each pair of blocks
is a group of bounded size that returns a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackframe.llm.components import components
from trackframe.llm.shingles import mixed, shingle_set
from trackframe.session import cut_lineage

CROWDED = 24             # documents at a token from which its pairs are left to blocks
BLOCK_ROWS = 256         # documents of a block
BLOCK_TOKENS = 2_000_000  # tokens of a block
SEEN = 4_000_000         # tokens a task counts at once
FREQUENT = 1 << 18       # tokens in the broadcast table of frequent ones
LOWER = (1 << 32) - 1
LATE = 1 << 19           # tokens in the broadcast table of crowded ones
FEW = 2048               # documents in crowded tokens that are left to blocks without another round
BROADCAST_IDS = 500_000  # ids that may be broadcast; of more, one bit each
WORDS = 19               # logarithm of the number of 64-bit words that hold those bits
ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)


def _frequent(docs: DataFrame, words: int, least: int = 3):
    """Tokens that tasks saw at least `least` times among SEEN, with their summed counts by powers of two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summary():
            tokens, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64),) * 2
            keep = n >= least
            return pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(n[keep], pa.int64())],
                                              ["token", "n"])

        for batch in batches:
            for value in batch.column(0):
                held.append(shingle_set(value.as_py(), words))
                size += len(held[-1])
                if size >= SEEN:
                    yield summary()
                    held, size = [], 0
        yield summary()

    top = (docs.select("_text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow())
    tokens = top["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    level = np.log2(np.maximum(top["n"].to_numpy(), 1)).astype(np.uint64)
    return tokens[order], level[order]


def _levels(tokens: np.ndarray, table) -> np.ndarray:
    known, level = table
    if not len(known):
        return np.zeros(len(tokens), np.uint64)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return np.where(known[at] == tokens, level[at], np.uint64(0))


def _ranks(tokens: np.ndarray, order: int, frequent, late=None) -> np.ndarray:
    level = _levels(tokens, frequent)
    if late is not None:
        level = np.maximum(level, _levels(tokens >> np.uint64(16), late))
    return (mixed(tokens ^ np.uint64(order)) >> np.uint64(8)) | level << np.uint64(56)


def prefix(tokens: np.ndarray, order: int, frequent, num: int, den: int, late=None) -> np.ndarray:
    """The tokens that come first under an order, as many as the similarity num / den asks for."""
    n = len(tokens)
    p = n + 1 - -(-num * n // den)
    return tokens[np.argpartition(_ranks(tokens, order, frequent, late), p - 1)[:p]] if 0 < p < n else tokens


def in_order(tokens: np.ndarray, order: int, frequent, late=None) -> np.ndarray:
    """Tokens sorted by an order, by themselves where it ties."""
    return tokens[np.lexsort((tokens, _ranks(tokens, order, frequent, late)))]


def _signed(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n and two sums that stand for the whole set."""

    def build(batches):
        for batch in batches:
            sets = [shingle_set(v.as_py(), words) for v in batch.column(1)]
            sums = [[int(f(s).sum(dtype=np.uint64)) for s in sets] for f in (mixed, lambda s: mixed(s ^ np.uint64(ORDERS[2])))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, sets), pa.int64()),
                 *(pa.array(np.array(s, np.uint64).view(np.int64)) for s in sums)], ["doc_id", "n", "d1", "d2"])

    return docs.select("doc_id", "_text").mapInArrow(build, "doc_id long, n long, d1 long, d2 long")


def _prefixes(docs: DataFrame, words: int, frequent, late, num: int, den: int) -> DataFrame:
    """token, doc_id, n, rest: the prefix under the first order, each token with how many of the whole set come from it
    on. 48 bits of a token find its meetings; n and rest share a column, n in the upper half."""

    def first(tokens):
        tokens = prefix(tokens, ORDERS[0], frequent.value, num, den, late.value)
        return in_order(tokens, ORDERS[0], frequent.value, late.value) >> np.uint64(16)

    def build(batches):
        for batch in batches:
            sets = [shingle_set(v.as_py(), words) for v in batch.column(1)]
            firsts = [first(s) for s in sets]
            size = [len(f) for f in firsts]
            sizes = [np.int64(len(s) << 32) + len(s) - np.arange(len(f)) for s, f in zip(sets, firsts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array((np.concatenate(firsts) if firsts else np.zeros(0, np.uint64)).view(np.int64)),
                 pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), size), pa.int64()),
                 pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64))], ["token", "doc_id", "sizes"])

    return docs.select("doc_id", "_text").mapInArrow(build, "token long, doc_id long, sizes long")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def build(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _signed([shingle_set(v.as_py(), words) for v in batch.column(1)])], ["doc_id", "tokens"])

    return docs.select("doc_id", "_text").mapInArrow(build, "doc_id long, tokens array<long>")


def sketch(tokens: np.ndarray) -> bytes:
    """A bit for each of 2**k places, as many as there are tokens or up to twice that, 64 at least: whether an odd
    number of tokens fall there. Sets whose sketches differ in d bits differ in d tokens or more."""
    places = max(64, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(x: pa.Array, y: pa.Array, most: int = 1 << 20) -> np.ndarray:
    """In how many bits the sketches of each row differ, the longer one folded to the other's places."""
    (at_x, x), (at_y, y) = ((np.frombuffer(v.buffers()[1], np.int32)[v.offset:v.offset + len(v) + 1].astype(np.int64),
                             np.frombuffer(v.buffers()[2], np.uint8)) for v in (x, y))
    long_x, long_y = np.diff(at_x), np.diff(at_y)
    out = np.zeros(len(long_x), np.int64)
    for m, n in np.unique(np.stack([long_x, long_y], axis=1), axis=0).tolist():
        same, k = np.flatnonzero((long_x == m) & (long_y == n)), min(m, n)
        step = max(1, most // max(m, n))
        for rows in (same[i:i + step] for i in range(0, len(same), step)):
            folded = (np.bitwise_xor.reduce(v[at[rows][:, None] + np.arange(size)].reshape(len(rows), -1, k), axis=1)
                      for v, at, size in ((x, at_x, m), (y, at_y, n)))
            out[rows] = np.bitwise_count(np.bitwise_xor(*folded)).sum(axis=1, dtype=np.int64)
    return out


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    def build(batches):
        for batch in batches:
            sets = [shingle_set(v.as_py(), words) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(map(sketch, sets), pa.binary())],
                ["doc_id", "n", "bits"])

    return docs.select("doc_id", "_text").mapInArrow(build, "doc_id long, n long, bits binary")


def _near_pairs(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sets can link by what their sketches leave them to share, a bound that is never too low."""

    def compare(batches):
        for batch in batches:
            n, m = (np.asarray(c) for c in batch.columns[2:4])
            most = np.minimum(np.minimum(n, m), (n + m - differing(*batch.columns[4:])) // 2)
            mask = pa.array(den * most >= num * (n + m - most))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    sketches = sketches.repartition("doc_id")
    sides = [sketches.select(*[F.col(k).alias(f"{k}_{s}") for k in sketches.columns]) for s in "ab"]
    return (pairs.join(sides[0], F.col("a") == F.col("doc_id_a")).join(sides[1], F.col("b") == F.col("doc_id_b"))
            .select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(compare, "a long, b long").distinct())


def _linked_pairs(near: DataFrame, sets: DataFrame, frequent, num: int, den: int) -> DataFrame:
    """The pairs that meet under the other orders too, and whose whole sets link."""

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.asarray(v.values).view(np.uint64) for v in (x, y))
                met = all(len(np.intersect1d(*(prefix(v, o, frequent.value, num, den) for v in (x, y)), assume_unique=True))
                          for o in ORDERS[1:])
                both = len(np.intersect1d(x, y, assume_unique=True)) if met else 0
                keep.append(met and den * both >= num * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    sides = [sets.select(*[F.col(k).alias(f"{k}_{s}") for k in sets.columns]) for s in "ab"]
    return (near.join(sides[0], F.col("a") == F.col("doc_id_a")).join(sides[1], F.col("b") == F.col("doc_id_b"))
            .select("a", "b", "tokens_a", "tokens_b").mapInArrow(compare, "a long, b long"))


def _with_bit(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, str]:
    """rows, and a column that is true where the id has the same place among the broadcast bits of all ids; its name."""
    key, own = ids.columns[0], "_" * (1 + max(map(len, rows.columns)))  # a name longer than any other
    word, bit = f"shiftrightunsigned(xxhash64(`{key}`), {64 - WORDS})", f"cast(xxhash64(`{key}`) & 63 AS int)"
    bits = ids.groupBy(F.expr(word).alias(f"{own}w")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias(f"{own}b"))
    held = rows.join(F.broadcast(bits), F.expr(word) == F.col(f"{own}w"), "left")
    return held.withColumn(own, F.expr(f"coalesce(shiftright({own}b, {bit}) & 1 = 1, false)")).drop(f"{own}w", f"{own}b"), own


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ids. Of many ids a bit each is broadcast, so that rows with whole texts or sets are
    not shuffled; rows of other ids that fall on the same bits come along then."""
    if ids.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids), ids.columns, "left_semi")
    held, bit = _with_bit(rows.dropna(subset=ids.columns), ids)
    return held.filter(bit).drop(bit)


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id, if any, is not among ids. Of many ids only rows that fall on their bits are shuffled."""
    if ids.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids), ids.columns, "left_anti")
    held, bit = _with_bit(rows, ids)
    other, same = held.filter(f"NOT {bit}").drop(bit), held.filter(bit).drop(bit)
    return other.unionByName(same.join(ids, ids.columns, "left_anti").select(*rows.columns))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def _meetings(rows: DataFrame, num: int, den: int) -> DataFrame:
    """From the prefixes: pairs (a, b) of tokens with few documents, (token, doc_id) of crowded ones. A pair is left out
    where a link would need more tokens than its sets share if this is the first shared one."""

    def meet(batches):
        names = ["crowded", "a", "b"]

        def out(crowded, a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), crowded)), pa.array(a), pa.array(b)], names)

        rest, flushed = np.zeros((3, 0), np.int64), None

        def runs(table, edges):
            size = np.diff(edges)
            for s in np.unique(size[size > 1]):
                at = edges[:-1][size == s][:, None] + np.arange(s)
                if s > CROWDED:
                    yield out(True, table[0][at].ravel(), table[1][at].ravel())
                    continue
                i, j = np.triu_indices(s, 1)
                a, b = table[1][at[:, i]].ravel(), table[1][at[:, j]].ravel()
                x, y = table[2][at[:, i]].ravel(), table[2][at[:, j]].ravel()
                most = np.minimum(x & LOWER, y & LOWER)
                ok = ((num + den) * most >= num * ((x >> 32) + (y >> 32))) & (a != b)
                pairs = np.unique(np.stack([a[ok], b[ok]]), axis=1)
                if pairs.shape[1]:
                    yield out(False, pairs[0], pairs[1])

        for batch in batches:
            table = np.stack([np.asarray(c) for c in batch.columns])
            if flushed is not None:
                n = int((table[0] == flushed).sum())
                if n:
                    yield out(True, table[0][:n], table[1][:n])
                if n == table.shape[1]:
                    continue
                table, flushed = table[:, n:], None
            table = np.concatenate([rest, table], axis=1)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(table[0])) + 1))
            yield from runs(table, edges)
            rest = table[:, edges[-1]:]
            if rest.shape[1] > CROWDED:
                yield out(True, rest[0], rest[1])
                rest, flushed = rest[:, :0], int(table[0, -1])
        if rest.shape[1] > 1:
            yield from runs(rest, np.array([0, rest.shape[1]]))

    return (rows.repartition("token").sortWithinPartitions("token", "doc_id")
            .mapInArrow(meet, "crowded boolean, a long, b long"))


def _met(nodes: DataFrame, words: int, frequent, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), and (token, doc_id) of the tokens that are still crowded after the last round."""
    rows, pairs, before = nodes, None, None
    tokens, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    while True:
        late = nodes.sparkSession.sparkContext.broadcast((tokens, np.log2(np.maximum(times, 1)).astype(np.uint64)))
        met = cut_lineage(_meetings(_prefixes(rows, words, frequent, late, num, den), num, den))
        found = met.filter("NOT crowded").select("a", "b")
        pairs = found if pairs is None else pairs.unionByName(found)
        crowded = met.filter("crowded").select(F.col("a").alias("token"), F.col("b").alias("doc_id")).distinct()
        ids = cut_lineage(crowded.select("doc_id").distinct())
        n = ids.count()
        if n <= FEW or before is not None and 5 * n > 4 * before:
            return pairs.distinct(), crowded
        rows, before = _among(nodes, ids), n
        tokens, times = _later(crowded, tokens, times)


def _later(crowded: DataFrame, tokens: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table of late tokens (sorted, with how many documents they had) with those of crowded added."""
    counts = cut_lineage(crowded.groupBy("token").agg(F.count("*").alias("n")))
    top = (counts if counts.count() <= LATE else counts.orderBy(F.desc("n"), "token").limit(LATE)).toArrow()
    tokens = np.concatenate([tokens, top["token"].to_numpy().view(np.uint64)])
    times = np.concatenate([times, top["n"].to_numpy()])
    often = np.lexsort((tokens, -times))  # a token that comes twice counts as often as it did when it did more
    first = often[np.sort(np.unique(tokens[often], return_index=True)[1])[:LATE]]
    by = first[np.argsort(tokens[first])]
    return tokens[by], times[by]


def _forest(left: np.ndarray, right: np.ndarray, ids_left, ids_right) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows left[i] and right[i]."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in zip(ids_left[left].tolist(), ids_right[right].tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def shared(lists: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """How many tokens each of the left rows shares with each of the right rows."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    tokens, at, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    often = times > 1
    place = np.cumsum(often) - 1
    use = often[at]
    owner, at = owner[use], place[at[use]]
    by = np.argsort(at, kind="stable")
    owner, at = owner[by], at[by]
    total = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, int(often.sum()), columns):
        lo, hi = np.searchsorted(at, (start, start + columns))
        m = np.zeros((len(lists), columns), np.float32)
        m[owner[lo:hi], at[lo:hi] - start] = 1
        total += (m[left] @ m[right].T).astype(np.int64)
    return total


def _family_links(members: DataFrame, sets: DataFrame, frequent, num: int, den: int) -> DataFrame:
    """A spanning forest of the links inside each family (doc_id, family)."""
    width = -math.log(num / den) * 1.01  # linked sizes are at most one class apart
    few = members.count() <= BROADCAST_IDS
    rows = sets.join(F.broadcast(members) if few else members, "doc_id").withColumn("n", F.size("tokens").cast("long")).withColumn(
        "c", F.floor(F.log(F.col("n").cast("double")) / width).cast("int"))
    sizes = rows.groupBy("family", "c").agg(F.ceil(F.greatest(
        F.count("*") / F.lit(BLOCK_ROWS), F.sum("n") / F.lit(BLOCK_TOKENS))).cast("int").alias("blocks"))
    near = sizes.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("c", "blocks"))).alias("blocks"))
    own, up, down = (F.coalesce(F.try_element_at("blocks", F.col("c") + k), F.lit(0)) for k in (0, 1, -1))

    def meetings(other_class, count, build):
        return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), build)

    def meeting(lc, lb, rc, rb, right):
        return F.struct(lc.alias("lc"), lb.alias("lb"), rc.alias("rc"), rb.alias("rb"), right.alias("right"))

    c, b = F.col("c"), F.col("b")
    placed = (rows.join(near, "family").withColumn("b", F.pmod(F.xxhash64("doc_id"), own).cast("int"))
              .withColumn("m", F.explode(F.concat(
                  meetings(c, own, lambda j: meeting(c, F.least(b, j), c, F.greatest(b, j), b > j)),
                  meetings(c + 1, up, lambda j: meeting(c, b, c + 1, j, F.lit(False))),
                  meetings(c - 1, down, lambda j: meeting(c - 1, j, c, b, F.lit(True))))))
              .select("family", "m.*", "doc_id", "tokens"))

    def link(group: pa.Table) -> pa.Table:
        ids, side = group["doc_id"].to_numpy(), np.asarray(group["right"])
        left = np.flatnonzero(~side)
        right = np.flatnonzero(side) if side.any() else left
        if group["lc"][0].as_py() == group["rc"][0].as_py() and group["lb"][0].as_py() != group["rb"][0].as_py() and not side.any():
            right = right[:0]
        if group["lc"][0].as_py() != group["rc"][0].as_py() and not side.any():
            right = right[:0]
        tokens = [np.asarray(x.values).view(np.uint64) for x in group["tokens"]]
        n = np.array([len(x) for x in tokens])
        kept: list = []
        if len(left) and len(right):
            met = np.logical_and.reduce([shared([prefix(x, o, frequent.value, num, den) for x in tokens], left, right) > 0
                                         for o in ORDERS[1:]])
            if met.any():
                both = shared(tokens, left, right)
                union = n[left][:, None] + n[right][None, :] - both
                i, j = np.nonzero(met & (den * both >= num * union) & (ids[left][:, None] != ids[right][None, :]))
                kept = _forest(i, j, ids[left], ids[right])
        return pa.table({"a": pa.array([x for x, _ in kept], pa.int64()), "b": pa.array([x for _, x in kept], pa.int64())})

    return placed.groupBy("family", "lc", "lb", "rc", "rb").applyInArrow(link, "a long, b long")


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row, linking texts with similarity num / den or more.

    Two rows link when den * |shared shingles| >= num * |all shingles|. Texts without words (null or empty)
    link with nothing. Rows that repeat an id are one node. A row without id is returned with a null component.
    The component is the smallest id that links reach. An empty table gives no rows. num / den must lie above 0.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    frequent = spark.sparkContext.broadcast(_frequent(source, words))
    every = cut_lineage(_signatures(source, words))
    found = every.filter("n > 0 AND doc_id IS NOT NULL")
    digests = found.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("node"))
    copies = cut_lineage(found.join(digests, ["d1", "d2", "n"]).filter("doc_id <> node"))
    # an id that repeats with another text may be a copy in one row and a node in the other: it stays
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")
    gone = cut_lineage(copies.select("doc_id").join(repeated, "doc_id", "left_anti").distinct())
    nodes = without(source.filter("doc_id IS NOT NULL"), gone)
    pairs, crowded = _met(nodes, words, frequent, num, den)
    hubs = crowded.groupBy("token").agg(F.min("doc_id").alias("hub"))
    touching = crowded.join(hubs, "token").select("doc_id", "hub").distinct()
    families = components(touching, "doc_id", "hub").select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    families = cut_lineage(families)
    met_ids = cut_lineage(_ends(pairs))
    near = cut_lineage(_near_pairs(pairs, _sketches(_among(source, met_ids), words), num, den))
    wanted = cut_lineage(_ends(near).unionByName(families.select("doc_id")).distinct())
    sets = cut_lineage(_sets(_among(source, wanted), words))
    direct = _linked_pairs(near, _among(sets, cut_lineage(_ends(near))), frequent, num, den)
    same = copies.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    loose = same.join(repeated.withColumnRenamed("doc_id", "a"), "a", "left_semi")
    linked = components(direct.unionByName(_family_links(families, sets, frequent, num, den)).unionByName(loose))
    named = digests.join(linked, "node", "left").select(
        "d1", "d2", "n", F.coalesce("component", "node").alias("component_id"))
    return every.join(named, ["d1", "d2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
