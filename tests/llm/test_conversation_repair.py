"""Repairs against every possible sequence of edits, and against a plain version of the whole contract."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from trackframe.llm import conversation_repair as cr

BLANK = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")


def faults(turns):
    """One of blank, duplicate, truncated or None for each (role, text)."""
    out, seen = [], set()
    for role, text in turns:
        said = BLANK.findall(text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else
                   "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def every_repair(turns):
    """(cost, audit, repaired) of the best of all edits, with at most two insertions in a place."""
    best = None
    edits = []
    for (role, text), fault in zip(turns, faults(turns)):
        cut = fault == "truncated"
        edits.append([(3, "D", [])] + ([] if fault in ("blank", "duplicate") else [
            (cut, "K", [(role, text)]), (2 + cut, "R", [("user", text)]), (2 + cut, "R", [("assistant", text)])]))
    inserts = [(0, "", [])] + [(2 * len(x), "I" * len(x), [(r, "") for r in x]) for x in (
        ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user"))]
    places = [inserts] + [p for e in edits for p in (e, inserts)]
    for chosen in itertools.product(*places):
        cost = sum(c for c, _, _ in chosen)
        if best and cost > best[0]:
            continue
        repaired = [t for _, _, new in chosen for t in new]
        if LEGAL.fullmatch("".join(r[:1] for r, _ in repaired)):
            found = cost, "".join(a for _, a, _ in chosen), repaired
            if best is None or found[:2] < best[:2]:
                best = found
    return best


def by_layers(turns):
    """(cost, audit, repaired) by keeping the best way to every state after every turn."""
    flip, name = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}

    def inserted(ways):
        for _ in range(2):
            for s, (c, x, new) in list(ways.items()):
                way = (c + 2, x + "I", [*new, (name[flip[s]], "")])
                if flip[s] not in ways or way[:2] < ways[flip[s]][:2]:
                    ways[flip[s]] = way
        return ways

    ways = inserted({"": (0, "", [])})
    for (role, text), fault in zip(turns, faults(turns)):
        new = {}
        for s, (c, x, done) in ways.items():
            options = [(s, c + 3, "D", [])]
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                if role[:1] and (s + role[:1] in ("u", "s", "su", "ua", "au")):
                    options.append((role[0], c + cut, "K", [(role, text)]))
                options.append((flip[s], c + 2 + cut, "R", [(name[flip[s]], text)]))
            for t, cost, letter, said in options:
                if t not in new or (cost, x + letter) < new[t][:2]:
                    new[t] = (cost, x + letter, done + said)
        ways = inserted(new)
    return min((ways[s] for s in ("", "a") if s in ways), key=lambda w: w[:2])


def contract(rows):
    """The rows that the query returns for (conv_id, turn, role, text) rows."""
    groups = {}
    for conv, turn, role, text in rows:
        kept = groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn is not None, turn or 0, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, kept in groups.items():
        kept.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        turns = [(r, t) for _, _, r, t in kept]
        known = {t for some, t, _, _ in kept if some}
        found = faults(turns)
        cost, audit, repaired = by_layers(turns)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:])]
        out.append((conv, max(known) - min(known) + 1 - len(known) if known else 0,
                    *[found.count(k) for k in ("blank", "duplicate", "truncated")],
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()))
    return out


def search(turns):
    """(cost, audit, repaired) by the operator's search."""
    seen, rows = set(), []
    for role, text in turns:
        rows.append((0, role, text, 1, (role, text) in seen))
        seen.add((role, text))
    cost, audit = cr.cheapest(cr.steps_of(rows))
    return cost, audit, cr.applied(rows, audit)


ROLES = ["system", "user", "assistant", "tool", "", " "]
TEXTS = ["Hello.", "Why?", "cut off", "", " \t", "Yes!", "no"]


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_search_equals_all_edits(n):
    rng = random.Random(n)
    for _ in range(1 if n == 0 else 60):
        turns = [(rng.choice(ROLES[:4]), rng.choice(TEXTS)) for _ in range(n)]
        assert search(turns) == every_repair(turns), turns


def test_search_equals_layers():
    rng = random.Random(8)
    for _ in range(1500):
        turns = [(rng.choice(ROLES), rng.choice(TEXTS) + rng.choice(["", "", str(rng.random())])) for _ in range(rng.randint(0, 14))]
        assert search(turns) == by_layers(turns), turns


def table(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("copies", "said", "kind", "part", "start", "repeat"):  # names the operator uses itself
        df = df.withColumn(name, F.lit("mine"))
    return df


def bag(rows):
    return sorted((tuple(r) for r in rows), key=str)


def sample(rng, conversations, turns):
    rows = []
    for conv in conversations:
        for turn in range(rng.randint(1, turns)):
            rows.append((conv, rng.choice([turn, turn, turn, turn // 2, None, turn * 3]), rng.choice([*ROLES[:3], *ROLES[:3], None, "tool"]),
                         rng.choice([*TEXTS, None, f"Turn {turn}."])))
    return rows


@pytest.mark.parametrize("segment", [1, 3, 1024])
def test_rows_of_the_contract(spark, segment):
    rng = random.Random(segment)
    rows = sample(rng, [None, *range(60)], 14) + sample(rng, [777], 400)
    got = cr.repairs(cr.damaged(table(spark, rows)), segment=segment).collect()
    assert bag(got) == bag(contract(rows))


def test_a_conversation_with_most_rows(spark):
    rng = random.Random(2)
    rows = [(5, k, rng.choice(ROLES[:3]), rng.choice(["Same.", "Same.", f"Turn {k}.", "x"])) for k in range(4000)]
    rows += [(6, 1, "user", "Again and again.")] * 3000 + sample(rng, range(10, 20), 6)
    df = cr.damaged(table(spark, rows).repartition(7))
    got = cr.repairs(df, segment=100).collect()
    assert bag(got) == bag(contract(rows))
    turns = cr.repaired_turns(df.filter("conv_id IN (5, 12)"), segment=100).orderBy("conv_id", "position").collect()
    for conv in (5, 12):
        mine = [r for r in turns if r["conv_id"] == conv]
        assert [r["position"] for r in mine] == list(range(len(mine)))
        said = "\n".join(f"{r['role']}:{r['text']}" for r in mine)
        assert hashlib.sha256(said.encode()).hexdigest() == next(r["repaired_sha256"] for r in got if r["conv_id"] == conv)


def test_dropped_conversations_empty_table_and_far_turns(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (-1, -(1 << 63), "user", "a."), (-1, (1 << 63) - 1, "assistant", "b."), (3, 0, "user", "long. " * 200_000)]
    got = {r["conv_id"]: r for r in cr.repairs(cr.damaged(table(spark, rows))).collect()}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[-1]["gaps"] is None and got[3]["cost"] >= 2
    assert cr.repairs(cr.damaged(table(spark, rows).limit(0))).count() == 0
