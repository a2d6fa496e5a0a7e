"""N-gram join, decontamination and repeated spans against plain versions."""

import collections
import math
import random

import numpy as np
import pyarrow as pa

from tests.llm.brute import jaccard_components
from tests.llm.conftest import ROWS
from trackframe.llm import components, decontamination, ngram_join, substring_dedup

OTHERS = [(None if d is None else d + 1000, t) for d, t in ROWS]


def some_texts(seed, n=120):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[rnd.choice(words) for _ in range(rnd.randint(5, 60))] for _ in range(8)]
    out = []
    for i in range(n):
        t = list(rnd.choice(bases)) if rnd.random() < 0.8 else [rnd.choice(words) for _ in range(rnd.randint(0, 30))]
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            if t:
                t[rnd.randrange(len(t))] = rnd.choice(words)
        out.append((i, " ".join(t)))
    return out


def same_components(spark, rows, k, num, den):
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()
    assert sorted((tuple(r) for r in got), key=str) == jaccard_components(rows, k, num, den)


def test_links_in_few_and_in_crowded_tokens(spark, monkeypatch):
    same_components(spark, some_texts(1), 4, 85, 100)
    monkeypatch.setattr(ngram_join, "CROWDED", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)
    same_components(spark, some_texts(2), 3, 60, 100)


def test_documents_of_common_runs_leave_the_families(spark, monkeypatch):
    rnd = random.Random(7)
    common = [" ".join(f"c{i}x{k}" for k in range(4)) for i in range(20)]  # in every text, which are not alike otherwise
    rows = [(d, " ".join(f"{rnd.choice(common)} " + " ".join(f"d{rnd.randrange(10**6)}" for _ in range(5)) for _ in range(12))) for d in range(90)]
    rows += [(100 + d, t + " more") for d, t in rows[:3]]
    monkeypatch.setattr(ngram_join, "_frequent", lambda *_: (np.zeros(0, np.uint64),) * 2)  # no task sees them often
    monkeypatch.setattr(ngram_join, "FEW", 0, raising=False)
    held, links = [], ngram_join._family_links
    monkeypatch.setattr(ngram_join, "_family_links", lambda members, *a: held.append(members.count()) or links(members, *a))
    same_components(spark, rows, 4, 85, 100)
    assert held == [0]


def test_rounds_find_the_links_of_copies_and_edits(spark, monkeypatch):
    for name, value in (("CROWDED", 2), ("BLOCK_ROWS", 4), ("FEW", 0), ("LATE", 30)):
        monkeypatch.setattr(ngram_join, name, value)
    same_components(spark, some_texts(3), 3, 60, 100)
    same_components(spark, some_texts(4) + OTHERS, 4, 85, 100)


def test_many_ids_are_found_by_bits(spark, docs, monkeypatch):
    ids = spark.createDataFrame([(i,) for i in (2, 3, 7, 15, 99)], "doc_id long")
    want = sorted((str(r) for r in docs.collect() if r["doc_id"] not in (2, 3, 7, 15, 99)))
    for words in (19, 1):  # with few bits other ids fall on them
        monkeypatch.setattr(ngram_join, "WORDS", words)
        for most in (500_000, 0):
            monkeypatch.setattr(ngram_join, "BROADCAST_IDS", most)
            assert sorted(map(str, ngram_join.without(docs, ids).collect())) == want
            got = ngram_join._among(docs, ids)
            assert got.columns == docs.columns and {2, 3, 7, 15} <= {r["doc_id"] for r in got.collect()}
            assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        same_components(spark, some_texts(5) + OTHERS, 3, 60, 100)


def test_sketches_never_differ_in_more_bits_than_sets_in_tokens():
    rng = np.random.default_rng(1)
    xs, ys, apart = [], [], []
    for n in [0, 1, 2, 63, 64, 65, 100, 129, 1000, 1025] * 3:
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[rng.integers(0, 2, n) < 1], rng.integers(0, 2**63, rng.integers(0, n + 2), dtype=np.uint64)])
        xs.append(x), ys.append(y), apart.append(len(np.setxor1d(x, y)))
    packed = [pa.array(map(ngram_join.sketch, v), pa.binary()) for v in (xs, ys)]
    for most in (1 << 20, 100):
        got = ngram_join.differing(*packed, most)
        assert (got <= apart).all() and (got % 2 == np.array(apart) % 2).all() and got.sum() > 0.4 * sum(apart)
        assert (ngram_join.differing(packed[0].slice(3), packed[1].slice(3), most) == got[3:]).all()
    assert (ngram_join.differing(packed[0], packed[0]) == 0).all()


def test_pairs_whose_first_shared_token_stands_too_late_are_left_out(spark):
    rows = [(1, 1, 20, 20), (1, 2, 20, 20), (2, 3, 20, 19), (2, 4, 20, 20), (3, 5, 20, 18), (3, 6, 20, 20), (4, 7, 20, 17), (4, 8, 17, 17)]
    sizes = spark.createDataFrame([(t, d, (n << 32) + rest) for t, d, n, rest in rows], "token long, doc_id long, sizes long")
    got = {(r.a, r.b) for r in ngram_join._meetings(sizes, 85, 100).collect()}
    assert got == {(a, b) for (_, a, n, x), (_, b, m, y) in zip(rows[::2], rows[1::2]) if 100 * min(x, y) >= 85 * (n + m - min(x, y))}
    assert (1, 2) in got and (5, 6) not in got


def test_join_of_odd_rows(docs, nothing, spark):
    got = ngram_join.jaccard_components(docs, 5, 80, 100).collect()
    assert sorted((tuple(r) for r in got), key=str) == jaccard_components(ROWS, 5, 80, 100)
    assert ngram_join.jaccard_components(nothing).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_leaks_are_found_and_clean_rows_left(spark, docs, nothing):
    rnd = random.Random(5)
    words = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(n))) for i, n in enumerate((30, 30, 45, 12, 3, 5, 0))] + [(9, None)]
    rest = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    edited = items[2][1].split()
    edited[-1] = "other"
    rows = [(1, rest(100) + " " + items[0][1].upper().replace(" ", ", ") + " " + rest(50)), (2, rest(300)), (3, items[1][1]),
            (4, rest(20) + " " + " ".join(edited)), (5, " ".join(items[1][1].split()[:-2])), (6, "pre " + items[4][1] + " post"),
            (7, items[5][1]), (8, " ".join(items[0][1].split()[:15]) + " " + rest(30))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 0), (3, 1), (4, 2), (5, 1), (6, 4), (7, 5)}
    assert next(r for r in got if r["doc_id"] == 1)["start"] == 100
    assert decontamination.leaks(docs, benchmark).count() == 0
    assert decontamination.leaks(nothing, benchmark).count() == 0
    assert decontamination.leaks(docs, benchmark.limit(0)).count() == 0
    own = decontamination.leaks(docs, docs.selectExpr("doc_id AS item_id", "text").filter("item_id = 1")).collect()
    assert {r["doc_id"] for r in own} == {1, 2, 3}


def best_windows(rows, items):
    """{(doc_id, item_id): greatest weighted similarity over all windows of the item's size} by trying each."""
    def runs(w):
        return collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])

    bags = {i: runs(t.split()) for i, t in items}
    held = collections.Counter(x for b in bags.values() for x in b)
    weight = lambda x: 1 + math.log(len(items) / held[x]) if x in held else 1 + math.log(len(items))
    out = {}
    for d, t in rows:
        words = t.split()
        for i, item in items:
            m, b = len(item.split()), bags[i]
            for s in range(max(len(words) - m, 0) + 1):
                w = runs(words[s:s + m])
                both = sum(weight(x) * n for x, n in (w & b).items())
                either = sum(weight(x) * n for x, n in (w | b).items())
                out[d, i] = max(out.get((d, i), 0.0), both / either)
    return out


def test_leaks_equal_those_of_all_windows_where_runs_are_rare_and_frequent(spark):
    rnd = random.Random(11)
    words = [f"v{i}" for i in range(2000)]
    some = lambda n: [rnd.choice(words) for _ in range(n)]
    common = some(14)  # a passage of many items, whose runs weigh little
    items = [(i, " ".join(some(n)[:n - 14] + common if i % 2 else some(n))) for i, n in enumerate([48, 60, 44, 70, 50, 56, 48, 52, 64, 45])]
    rows = []
    for d in range(60):
        t = rnd.choice(items)[1].split()
        kind = d % 4
        if kind == 0:    # the light passage is changed
            for at in rnd.sample(range(max(len(t) - 14, 0), len(t)), 3):
                t[at] = rnd.choice(words)
        elif kind == 1:  # one word is changed
            t[rnd.randrange(len(t))] = rnd.choice(words)
        elif kind == 2:  # an end is cut off, or the light passage stands before
            t = common + t[rnd.randint(0, 8):]
        else:
            t = t[:len(t) - rnd.randint(0, 8)]
        rows.append((d, " ".join(some(rnd.randint(0, 12)) + t + some(rnd.randint(0, 12)))))
    best = best_windows(rows, items)
    want = {k for k, v in best.items() if v >= 0.8}
    got = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"),
                                spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(want) > 20 and found <= want
    assert len(found) >= 0.95 * len(want)  # the others lie beyond the radius
    assert all(abs(r["similarity"] - best[r["doc_id"], r["item_id"]]) < 1e-6 for r in got)


def test_windows_by_weight_are_those_of_the_bound(spark):
    rnd = random.Random(3)
    most, sizes = 3.0, [7, 9, 15]
    rows = []
    for d in range(30):
        n = rnd.randint(5, 40)
        for place in range(n - 4):
            if rnd.random() < 0.8:
                rows.append((d, d, n, place, place, rnd.choice([1.0, 1.5, 3.0]), rnd.sample(sizes, rnd.randint(1, 3))))
    schema = "_id long, _key long, n int, place int, run long, w double, ms array<int>"
    got = {tuple(r) for r in decontamination._promising(spark.createDataFrame(rows, schema), most, 0.8).collect()}
    want, must = set(), set()
    for d in {r[0] for r in rows}:
        mine = {r[3]: r for r in rows if r[0] == d}
        n = next(iter(mine.values()))[2]
        for m in {x for r in mine.values() for x in r[6]}:
            for s in {*mine, max(n - m, 0)}:
                if s > max(n - m, 0):
                    continue
                places = range(s, s + max(min(n, m) - 4, 1))
                known = sum(mine[p][5] for p in places if p in mine and m in mine[p][6])
                whole = sum(mine[p][5] if p in mine else most for p in places)
                if known >= 0.8 * whole - 1e-5:
                    want.add((d, d, m, s))
                if known >= 0.8 * whole:
                    must.add((d, d, m, s))
    assert must <= got <= want and must


def test_fingerprints_of_long_rows_use_wider_counters(spark):
    rnd = random.Random(2)
    rows = [(i, [f"w{rnd.randrange(50)}" for _ in range(n)]) for i, n in enumerate((1, 7, 300))] + [(3, ["a"] * 40_000 + ["b"] * 30_000)]
    df = spark.createDataFrame(rows, "i int, words array<string>")
    wide = {r["i"]: r["mark"] for r in decontamination.fingerprint(df, ["i"], longest=70_000).collect()}
    narrow = {r["i"]: r["mark"] for r in decontamination.fingerprint(df.filter("i < 3"), ["i"]).collect()}
    assert {i: wide[i] for i in narrow} == narrow
    assert wide[3] == spark.range(1).selectExpr("xxhash64('a') AS h").first()["h"]


def test_radius_is_guaranteed_by_the_parts():
    ball = set(decontamination._ball())
    rnd = random.Random(1)
    for _ in range(300):
        far = 0
        for b in rnd.sample(range(64), decontamination.RADIUS):
            far |= 1 << b
        parts = [(far >> (decontamination.BITS * i)) & 0xFFFF for i in range(decontamination.BLOCKS)]
        assert any(p in ball for p in parts)


def test_later_repeats_of_passages_go(spark, docs, nothing):
    p = "This passage has quite a few words in it. It goes on for several sentences here. Then it ends at last. "
    rows = [(1, "Start one. " + p + "End one."), (2, "Other start. " + p + "Other end."), (3, p + p), (4, "Short. Text."), (5, None)]
    got = {r["doc_id"]: r for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {2, 3}
    assert got[2]["text"] == "Other start. Other end." and got[3]["text"] == "" and got[2]["first_ids"] == [1]
    changed = {r["doc_id"] for r in substring_dedup.without_repeats(docs).collect()}
    assert changed == {2}
    assert substring_dedup.without_repeats(nothing).count() == 0


def test_first_places_carry_one_id(docs):
    plan = substring_dedup.without_repeats(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "min(doc_id" in plan and "max(" not in plan


def test_rows_of_one_id_join_their_links(spark):
    rows = [(1, "a b c d e"), (5, "a b c d e"), (5, "p q r s t"), (7, "p q r s t"), (9, "x y z"), (9, None)]
    same_components(spark, rows, 4, 85, 100)


def test_any_shared_run_of_fifty_words_holds_a_span():
    rnd = random.Random(1)

    def some(n, ends, words=300):
        return " ".join(f"w{rnd.randrange(words)}" + "." * (rnd.random() < ends) for _ in range(n))

    for _ in range(300):
        run = some(50, rnd.choice([0, 0.02, 0.05, 0.1, 0.3]), rnd.choice([1, 2, 5, 300]))
        a, b = (" ".join([some(rnd.randrange(40), e), run, some(rnd.randrange(40), e)]) for e in (0.05, 0.3))
        assert {s[0] for s in substring_dedup.spans(a)} & {s[0] for s in substring_dedup.spans(b)}


def test_repeats_inside_long_sentences_go(spark):
    rnd = random.Random(2)
    words = lambda n: " ".join(f"v{rnd.randrange(10_000)}" for _ in range(n))
    p, run = words(80), "so " * 300
    short = "One two three four five six seven eight nine ten. Short end here now. Last bit. "
    rows = [(1, f"{words(30)} {p} {words(30)}."), (2, f"{words(5)} {p} {words(9)}."), (3, run), (4, "x. " + run),
            (5, "Mine. " + short + words(20) + "."), (6, short + words(30) + ".")]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {2, 4, 6}
    assert len(set(got[2].split()) & set(p.split())) <= 30 and got[4] == "x. " and not set(got[6].split()) & set(short.split())
