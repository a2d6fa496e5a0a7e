"""Cheapest repair of conversations by a bidirectional search over the edit lattice.

A node of the lattice is (turns read, what the repaired conversation ends with); an edge keeps, re-roles or deletes
the next turn, or inserts one. A forward heap starts at the beginning, a reverse heap at the accepted ends. Both run
on until no path of the best cost can be left unseen; every node and edge where the two sides meet at that cost is
a crossing, and the least concatenated audit of all crossings is the answer. Audits of equal cost between the same
two nodes are never a proper prefix of each other (what follows could only be inserted, which costs), so least parts
make least wholes.

Turns are sorted in ranges of (conversation, turn, role, text), not by conversation, so a conversation of any
length is spread over tasks. Identical turns are counted before they are shuffled. A conversation that lies inside
one task and is not long is repaired there. Any other is cut into segments of bounded length; a segment is searched
from every state to every state, the segments' few cheapest ways are chained, and the way chosen is applied to
each segment again by itself. What one task sees of a whole long conversation is a few letters per turn.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trackframe.llm.texts import partitions_of
from trackframe.session import cut_lineage

SEGMENT = 1024              # turns of a segment
SEGMENT_CHARS = 4_000_000   # or as many characters
RANGE_CHARS = 200           # of a text, in the keys that ranges are chosen by

REROLE, INSERT, DELETE = 2, 2, 3
BLANK_CHARS = " \t\n\x0b\x0c\r"

# What a repaired conversation ends with: 0 nothing yet, 1 system, 2 user, 3 assistant.
ACCEPTED = (0, 3)
NEXT = (2, 2, 3, 2)         # after the user or assistant turn that may follow
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
BEFORE = ((), (), (0, 1, 3), (2,))  # states p with NEXT[p] == state
NAMES = (None, None, "user", "assistant")

Step = tuple[int, str, int]  # deletions required, or 0 with a role's initial and 1 for a truncated turn


def _into(steps: list[Step], i: int, s: int):
    """Edges into a node: (turns read, state, cost, letters)."""
    for p in BEFORE[s]:
        yield i, p, INSERT, "I"
    if i:
        times, initial, truncated = steps[i - 1]
        if times:
            yield i - 1, s, DELETE * times, "D" * times
            return
        yield i - 1, s, DELETE, "D"
        for p, q in enumerate(KEPT.get(initial, ())):
            if q == s:
                yield i - 1, p, truncated, "K"
        for p in BEFORE[s]:
            yield i - 1, p, REROLE + truncated, "R"


def _from(steps: list[Step], i: int, s: int):
    """Edges out of a node."""
    yield i, NEXT[s], INSERT, "I"
    if i < len(steps):
        times, initial, truncated = steps[i]
        if times:
            yield i + 1, s, DELETE * times, "D" * times
            return
        yield i + 1, s, DELETE, "D"
        kept = KEPT.get(initial, (None,) * 4)[s]
        if kept is not None:
            yield i + 1, kept, truncated, "K"
        yield i + 1, NEXT[s], REROLE + truncated, "R"


def cheapest(steps: list[Step], source: int = 0, targets=ACCEPTED) -> tuple[int, str] | None:
    """Cost and audit of the cheapest way from `source` to one of `targets`, the least audit of equal ones.

    Nodes are settled by cost, then by turns read in the direction of the search, so that all cheapest ways into
    a node are settled before it and its least audit is known at once.
    """
    n = len(steps)
    forward: dict[tuple[int, int], tuple[int, str]] = {}
    reverse: dict[tuple[int, int], tuple[int, str]] = {}
    ahead, behind = [(0, 0, source)], [(0, -n, s) for s in targets]
    heapq.heapify(behind)
    best = None

    def settle_forward():
        nonlocal best
        cost, i, s = heapq.heappop(ahead)
        if (i, s) in forward:
            return
        audits = [forward[j, p][1] + letters for j, p, w, letters in _into(steps, i, s)
                  if (j, p) in forward and forward[j, p][0] + w == cost]
        forward[i, s] = cost, min(audits) if cost or i else ""
        if (i, s) in reverse and (best is None or cost + reverse[i, s][0] < best):
            best = cost + reverse[i, s][0]
        for j, q, w, _ in _from(steps, i, s):
            if (j, q) in reverse and (best is None or cost + w + reverse[j, q][0] < best):
                best = cost + w + reverse[j, q][0]
            if (j, q) not in forward:
                heapq.heappush(ahead, (cost + w, j, q))

    def settle_reverse():
        nonlocal best
        cost, i, s = heapq.heappop(behind)
        i = -i
        if (i, s) in reverse:
            return
        audits = [letters + reverse[j, q][1] for j, q, w, letters in _from(steps, i, s)
                  if (j, q) in reverse and reverse[j, q][0] + w == cost]
        if i == n and s in targets:
            audits.append("")
        reverse[i, s] = cost, min(audits)
        if (i, s) in forward and (best is None or cost + forward[i, s][0] < best):
            best = cost + forward[i, s][0]
        for j, p, w, _ in _into(steps, i, s):
            if (j, p) in forward and (best is None or cost + w + forward[j, p][0] < best):
                best = cost + w + forward[j, p][0]
            if (j, p) not in reverse:
                heapq.heappush(behind, (cost + w, -j, p))

    settle_forward()
    while ahead and behind and (best is None or ahead[0][0] + behind[0][0] <= best):
        if behind[0][0] <= ahead[0][0]:
            settle_reverse()
        else:
            settle_forward()
    if best is None:
        return None
    least = None
    for (i, s), (cost, audit) in forward.items():
        after = reverse.get((i, s))
        if after and cost + after[0] == best:
            found = audit + after[1]
            least = found if least is None or found < least else least
        for j, q, w, letters in _from(steps, i, s):
            after = reverse.get((j, q))
            if after and cost + w + after[0] == best:
                found = audit + letters + after[1]
                least = found if least is None or found < least else least
    return best, least


def steps_of(turns: list[tuple]) -> list[Step]:
    """Steps of (turn, role, text, copies, duplicate) rows; deletions that follow each other are one step."""
    out: list[Step] = []
    for _, role, text, copies, duplicate in turns:
        forced = copies
        if copies and not duplicate and text.strip(BLANK_CHARS):
            out.append((0, role[:1], int(_truncated(text))))
            forced -= 1
        if forced:
            if out and out[-1][0]:
                out[-1] = (out[-1][0] + forced, "", 0)
            else:
                out.append((forced, "", 0))
    return out


def _truncated(text: str) -> bool:
    return text.rstrip(BLANK_CHARS)[-1] not in ".!?"


def applied(turns: list[tuple], audit: str, state: int = 0) -> list[tuple[str, str]]:
    """(role, text) of the repaired turns when `audit` is carried out from `state`."""
    out, letters = [], iter(audit)

    def step():
        nonlocal state
        for letter in letters:
            if letter != "I":
                return letter
            state = NEXT[state]
            out.append((NAMES[state], ""))

    for _, role, text, copies, duplicate in turns:
        forced = copies
        if copies and not duplicate and text.strip(BLANK_CHARS):
            forced -= 1
            letter = step()
            if letter == "K":
                state = KEPT[role[:1]][state]
                out.append((role, text))
            elif letter == "R":
                state = NEXT[state]
                out.append((NAMES[state], text))
        for _ in range(forced):
            step()
    step()
    return out


def legal(first: str, second: str) -> bool:
    return first + second in ("su", "ua", "au")


def counters(turns: list[tuple]) -> dict:
    """Faults of a stretch of turns, its first and last role initials, its turn numbers from low to high."""
    c = dict(blank=0, duplicate=0, truncated=0, illegal=0, turns=0, low=None, high=None, first=None, last=None)
    for turn, role, text, copies, duplicate in turns:
        if not copies:
            continue
        if not text.strip(BLANK_CHARS):
            c["blank"] += copies
        else:
            c["duplicate"] += copies if duplicate else copies - 1
            c["truncated"] += 0 if duplicate else _truncated(text)
        initial = role[:1]
        if c["last"] is not None:
            c["illegal"] += not legal(c["last"], initial)
        c["illegal"] += (copies - 1) * (not legal(initial, initial))
        c["first"] = initial if c["first"] is None else c["first"]
        c["last"] = initial
        if turn is not None and turn != c["high"]:
            c["turns"] += 1
            c["low"] = turn if c["low"] is None else c["low"]
            c["high"] = turn
    return c


def joined(a: dict, b: dict) -> dict:
    """Counters of two stretches that follow each other."""
    c = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    c["illegal"] += a["last"] is not None and b["first"] is not None and not legal(a["last"], b["first"])
    c["turns"] -= a["high"] is not None and a["high"] == b["low"]
    for k, first in (("low", True), ("first", True), ("high", False), ("last", False)):
        one, other = (a[k], b[k]) if first else (b[k], a[k])
        c[k] = other if one is None else one
    return c


def gaps(c: dict) -> int | None:
    """Turn numbers missing between the lowest and the highest; null where a long cannot hold it."""
    if c["low"] is None:
        return 0
    n = c["high"] - c["low"] + 1 - c["turns"]
    return n if n < 1 << 63 else None


def sha256(turns) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in turns).encode()).hexdigest()


FOUND = pa.schema([
    ("kind", pa.string()), ("conv_id", pa.int64()), ("part", pa.int64()), ("seg", pa.int64()), ("at", pa.int64()),
    *[(k, pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")],
    ("first", pa.string()), ("last", pa.string()), ("gaps", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
    ("state", pa.int64()), ("repaired_sha256", pa.string()),
    ("ways", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]))),
    ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("repeat", pa.bool_()),
    ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
FOUND_SQL = ("kind string, conv_id long, part long, seg long, at long, blank long, duplicate long, truncated long, "
             "illegal long, turns long, low long, high long, first string, last string, gaps long, cost long, "
             "audit string, state long, repaired_sha256 string, "
             "ways array<struct<a: long, b: long, cost: long, audit: string>>, turn long, role string, text string, "
             "copies long, repeat boolean, repaired array<struct<role: string, text: string>>")
RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _batches(rows: Iterator[dict], most: int = 2000, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("text") or "") + sum(len(t["text"]) for t in row.get("repaired") or ())
        if len(held) >= most or size >= chars:
            yield pa.RecordBatch.from_pylist(held, FOUND)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, FOUND)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _searched(texts: bool, segment: int, segment_chars: int):
    """Task over sorted turns: conversations that lie inside are `done`, others give `segment` and `row` rows."""

    def segment_rows(cid, part, seg, turns):
        steps = steps_of(turns)
        ways = []
        for a in range(4):
            for b in range(4):
                way = cheapest(steps, a, (b,))
                if way:
                    ways.append({"a": a, "b": b, "cost": way[0], "audit": way[1]})
        yield {"kind": "segment", "conv_id": cid, "part": part, "seg": seg, "at": -1, "ways": ways, **counters(turns)}
        for at, (turn, role, text, copies, repeat) in enumerate(turns):
            yield {"kind": "row", "conv_id": cid, "part": part, "seg": seg, "at": at, "turn": turn, "role": role,
                   "text": text, "copies": copies, "repeat": repeat}

    def done(cid, turns):
        cost, audit = cheapest(steps_of(turns))
        new, c = applied(turns, audit), counters(turns)
        return {"kind": "done", "conv_id": cid, **c, "gaps": gaps(c), "cost": cost, "audit": audit,
                "repaired_sha256": sha256(new),
                "repaired": [{"role": r, "text": t} for r, t in new] if texts else None}

    def rows(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        now, edge, seg, chars, some = None, True, 0, 0, False  # edge: the conversation may have begun elsewhere
        for cid, *turn in _rows(batches):
            if some and cid != now:
                if edge or seg:
                    yield from segment_rows(now, part, seg, held)
                else:
                    yield done(now, held)
                held, edge, seg, chars = [], False, 0, 0
            elif len(held) >= segment or chars >= segment_chars:
                yield from segment_rows(now, part, seg, held)
                held, seg, chars = [], seg + 1, 0
            now, some = cid, True
            held.append(tuple(turn))
            chars += len(turn[2] or "")
        if some:
            yield from segment_rows(now, part, seg, held)

    return lambda batches: _batches(rows(batches))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over the segments of conversations in order: a `whole` row for each and a `path` row per segment.

    For every state the cheapest way to it is known by pointers back; what its audit has beyond the part that all
    states share is kept to compare ways of equal cost.
    """

    def finish(cid, total, tails, back):
        cost, tail, state = min((*tails[s], s) for s in ACCEPTED if s in tails)
        pieces = []
        for part, seg, into in reversed(back):
            before, audit = into[state]
            pieces.append((part, seg, before, audit))
            state = before
        pieces.reverse()
        yield {"kind": "whole", "conv_id": cid, "part": -1, "seg": -1, "at": -1, **total, "gaps": gaps(total),
               "cost": cost, "audit": "".join(p[3] for p in pieces)}
        for part, seg, before, audit in pieces:
            yield {"kind": "path", "conv_id": cid, "part": part, "seg": seg, "at": -1, "state": before, "audit": audit}

    def rows():
        names = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")
        now, total = None, None
        for cid, part, seg, ways, *values in _rows(batches):
            c = dict(zip(names, values))
            if total is not None and cid != now:
                yield from finish(now, total, tails, back)
                total = None
            if total is None:
                total, tails, back = c, {0: (0, "")}, []
            else:
                total = joined(total, c)
            now, new, into = cid, {}, {}
            for w in ways:
                if w["a"] in tails:
                    cost, tail = tails[w["a"]]
                    way = (cost + w["cost"], tail + w["audit"])
                    if w["b"] not in new or way < new[w["b"]]:
                        new[w["b"]], into[w["b"]] = way, (w["a"], w["audit"])
            low, high = min(t for _, t in new.values()), max(t for _, t in new.values())
            same = next((k for k, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
            tails = {s: (cost, tail[same:]) for s, (cost, tail) in new.items()}
            back.append((part, seg, into))
        if total is not None:
            yield from finish(now, total, tails, back)

    return _batches(rows())


def _repaired_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over `path` rows, each followed by the `row` rows of its segment."""

    def rows():
        head, held = None, []

        def piece():
            cid, part, seg, state, audit = head
            return {"kind": "piece", "conv_id": cid, "part": part, "seg": seg, "at": 0,
                    "repaired": [{"role": r, "text": t} for r, t in applied(held, audit, state)]}

        for kind, cid, part, seg, state, audit, *turn in _rows(batches):
            if kind == "path":
                if head:
                    yield piece()
                head, held = (cid, part, seg, state, audit), []
            else:
                held.append(tuple(turn))
        if head:
            yield piece()

    return _batches(rows())


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over `whole` rows, each followed by its pieces in order. The hash runs on from piece to piece, so
    that a conversation is never held."""

    def rows():
        head, digest, some = None, None, False
        for kind, repaired, *values in _rows(batches):
            if kind == "whole":
                if head:
                    yield {**head, "repaired_sha256": digest.hexdigest()}
                head, digest, some = dict(zip(RESULT, values)), hashlib.sha256(), False
            else:
                for t in repaired:
                    digest.update(f"{'\n' if some else ''}{t['role']}:{t['text']}".encode())
                    some = True
        if head:
            yield {**head, "repaired_sha256": digest.hexdigest()}

    schema = pa.schema([FOUND.field(k) for k in RESULT])
    held = []
    for row in rows():
        held.append(row)
        if len(held) >= 2000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def counted(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copies of a table of turns; a null role or text becomes one space."""
    space = F.lit(" ")
    return conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), space).alias("role"),
        F.coalesce(F.col(text).cast("string"), space).alias("text"), F.lit(1).cast("long").alias("copies"))


def damaged(conversations: DataFrame) -> DataFrame:
    """`counted` rows after the damage that crc32 of "conv_id:turn" (null: one space) modulo 20 names: 0 drops the
    turn, 1 empties its text, 2 removes `.`, `!` and `?`, 3 repeats it, 4 makes its role user. A dropped turn stays
    as a row without copies, role and text, which keeps its conversation."""
    rows = counted(conversations)
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kept = rows.withColumn("kind", F.pmod(F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")), F.lit(20)))
    gone = F.col("kind") == 0
    return kept.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"),
        F.when(F.col("kind") == 4, F.lit("user")).when(~gone, F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .when(~gone, F.col("text")).alias("text"),
        F.when(gone, F.lit(0)).when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"))


def searched(rows: DataFrame, texts: bool = False, segment: int = SEGMENT, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """What the first pass finds in `counted` rows: conversations done, and segments with their turns."""
    spark = rows.sparkSession
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    seen = rows.select("conv_id", "turn", said.alias("said")).filter("said IS NOT NULL").groupBy("conv_id", "said").agg(
        F.count("*").alias("n"), F.min("turn").alias("since"), F.max(F.col("turn").isNull()).alias("open")).filter("n > 1").select(
        F.col("conv_id").alias("seen_id"), F.col("said").alias("seen_said"), "since", "open")
    turns = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("said", said)
    repeat = F.when(F.col("open"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("since"))
    marked = turns.join(seen, F.col("conv_id").eqNullSafe(F.col("seen_id")) & (F.col("said") == F.col("seen_said")), "left").select(
        "conv_id", "turn", "role", "text", "copies", F.coalesce(repeat, F.lit(False)).alias("repeat"))
    ranged = marked.withColumn("start", F.substring("text", 1, RANGE_CHARS)).repartitionByRange(
        partitions_of(spark), "conv_id", "turn", "role", "start").sortWithinPartitions("conv_id", "turn", "role", "text")
    return cut_lineage(ranged.select("conv_id", "turn", "role", "text", "copies", "repeat").mapInArrow(
        _searched(texts, segment, segment_chars), FOUND_SQL))


def _long_ones(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`whole` and `path` rows, and `piece` rows, of the conversations that were cut into segments."""
    n = partitions_of(found.sparkSession)
    segments = found.filter("kind = 'segment'").select(
        "conv_id", "part", "seg", "ways", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")
    chained = cut_lineage(segments.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "seg").mapInArrow(_chained, FOUND_SQL))
    rows = found.filter("kind = 'row'").unionByName(chained.filter("kind = 'path'"))
    pieces = (rows.select("kind", "conv_id", "part", "seg", "at", "state", "audit", "turn", "role", "text", "copies", "repeat")
              .repartition(n, "conv_id", "part", "seg").sortWithinPartitions("conv_id", "part", "seg", "at")
              .select("kind", "conv_id", "part", "seg", "state", "audit", "turn", "role", "text", "copies", "repeat")
              .mapInArrow(_repaired_pieces, FOUND_SQL))
    return chained, pieces


def repairs(rows: DataFrame, segment: int = SEGMENT, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """One row per conversation of `counted` rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    Turns are taken by turn number, nulls first, then role, then text. A null conv_id is a conversation like any
    other. A conversation without turns left costs nothing and has an empty audit; an empty table gives no rows.
    An empty or unknown role cannot be kept. Conversations and texts may be of any length: only the hash of a long
    conversation runs through one task, piece by piece, and the audit of a conversation is one value.
    """
    found = searched(rows, False, segment, segment_chars)
    chained, pieces = _long_ones(found)
    order = ["kind", "repaired", *RESULT]
    stream = (chained.filter("kind = 'whole'").unionByName(pieces).repartition(partitions_of(rows.sparkSession), "conv_id")
              .sortWithinPartitions("conv_id", "part", "seg").select(*order))
    schema = ", ".join(f"{k} {'string' if k in ('audit', 'repaired_sha256') else 'long'}" for k in RESULT)
    return found.filter("kind = 'done'").select(*RESULT).unionByName(stream.mapInArrow(_hashed, schema))


def repaired_turns(rows: DataFrame, segment: int = SEGMENT, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text."""
    found = searched(rows, True, segment, segment_chars)
    _, pieces = _long_ones(found)
    pieces = cut_lineage(pieces.select("conv_id", "part", "seg", "repaired"))
    sizes = pieces.select("conv_id", "part", "seg", F.size("repaired").cast("long").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part", "seg")) - F.col("n")
    starts = sizes.select(F.col("conv_id").alias("_id"), F.col("part").alias("_part"), F.col("seg").alias("_seg"), before.alias("before"))
    long = pieces.join(starts, F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part")) & (F.col("seg") == F.col("_seg")))
    every = found.filter("kind = 'done'").select("conv_id", "repaired", F.lit(0).cast("long").alias("before")).unionByName(
        long.select("conv_id", "repaired", "before"))
    return every.select("conv_id", "before", F.posexplode("repaired").alias("at", "turn")).select(
        "conv_id", (F.col("before") + F.col("at")).alias("position"), "turn.role", "turn.text")
