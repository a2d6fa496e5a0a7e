"""Operators that return something for every row, against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.brute import personal_spans
from tests.llm.conftest import ROWS
from trackframe.llm import fingerprints, licenses, lm_scoring, packing, pii, token_counts, toxicity

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def bag(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_token_counts(docs, nothing):
    t = Tokenizer.from_file(BYTES)
    want = [(d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False)), n > 512) for d, x in ROWS]
    assert bag(token_counts.token_counts(docs, BYTES).collect()) == bag(want)
    assert token_counts.token_counts(nothing, BYTES).count() == 0
    assert token_counts.with_token_counts(docs, BYTES).columns == [*docs.columns, "n_tokens"]


@pytest.mark.parametrize("text", ["a  b", "a   b", "a\n\n b", " a", "a ", "x\n <|endoftext|> y", "é   b", "  "])
def test_token_counts_of_odd_spaces(text):
    t = token_counts.load(BYTES)
    assert token_counts.Lengths(t, {}).of(text) == len(t.encode(text, add_special_tokens=False))


def test_words_of_letters_go_to_the_model_alone():
    t, words, met = Tokenizer.from_file(WORDS), packing.WordIds(WORDS, 1000), []

    class Kept:
        def encode(self, text, **how):
            met.append(text)
            return t.encode(text, **how)

    words.tokenizer = Kept()
    text = "Strasse strasse### na\u00efve\u00c9t, \u00c9t\u00e9 12. \u0130! \u0130. \ufb2a! it's <|endoftext|>. a<|endoftext|>!"
    want = np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert words.of(text.encode().split()) == want
    assert not {w for w in met if w.isalpha()} - {"\u0130", "\ufb2a"} and "strasse###" not in met


def test_packing_holds_every_id_once(docs, nothing):
    t = Tokenizer.from_file(WORDS)
    got = packing.packed(docs, WORDS, capacity=64).collect()
    want, places = [], collections.defaultdict(list)
    for d, x in ROWS:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        for at in range(0, len(ids), 64):
            part = ids[at:at + 64]
            want.append((d, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
    assert bag(tuple(r)[:5] for r in got) == bag(want)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 64
    assert packing.packed(nothing, WORDS).count() == 0


def least_bins(histogram, capacity):
    """A bound on any packing: long pieces need bins of their own, and what they leave may not hold the short ones."""
    best = 0
    for least in range(capacity // 2 + 1):
        alone = sum(n for k, n in histogram.items() if k > capacity - least)
        half = {k: n for k, n in histogram.items() if capacity / 2 < k <= capacity - least}
        short = sum(k * n for k, n in histogram.items() if least <= k <= capacity / 2)
        left = sum(half.values()) * capacity - sum(k * n for k, n in half.items())
        best = max(best, alone + sum(half.values()) + max(0, -(-(short - left) // capacity)))
    return best


def first_fit(histogram, capacity):
    """Bins when the pieces, longest first, go to the first bin with room."""
    rooms = []
    for k in sorted(histogram, reverse=True):
        for _ in range(histogram[k]):
            at = next((i for i, room in enumerate(rooms) if room >= k), None)
            if at is None:
                rooms.append(capacity - k)
            else:
                rooms[at] -= k
    return len(rooms)


def test_plan_fills_windows_from_any_histogram():
    rng = np.random.default_rng(3)
    for _ in range(20):
        histogram = {int(k): int(n) for k, n in zip(rng.integers(1, 65, 30), rng.integers(1, 50, 30))}
        rows, held, used = packing.plan(histogram, 64), collections.Counter(), collections.Counter()
        for length, first, end, sequence, copies, offset in rows:
            used[length] += end - first
            for i in range(end - first):
                held[sequence + i // copies] += length
        assert used == histogram and max(held.values()) <= 64
        assert least_bins(histogram, 64) <= len(held) <= first_fit(histogram, 64) * 1.02


def test_personal_data(docs, nothing):
    want = []
    for d, x in ROWS:
        s = personal_spans(x)
        kinds = collections.Counter(k for *_, k in s)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        want.append((d, *(kinds[k] for k in ("email", "ip", "card", "phone")), hashlib.sha256(text.encode()).hexdigest(), text))
    assert bag(pii.personal_data(docs).collect()) == bag(want)
    assert pii.personal_data(nothing).count() == 0


def test_contexts_of_seeds_find_unknown_identifiers(spark):
    rows = [(i, f"text {chr(97 + i)}x member mail: user{i}@site{i}.org then more") for i in range(8)]
    rows += [(20, "here member mail: user77_site and more"), (21, "nothing of it: user78_site"), (22, "member mail: plain")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20] == "email:18:29" and not got[21] and not got[22]


def test_masking_keeps_the_rest(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("mail a@b.cd, ip 1.2.3.4!",), ("é 𝒳 +1 234 567 8901",), ("clean",)], "text string")
    spans = F.concat(*pii.base_spans(F.col("text")).values())
    got = [r[0] for r in df.select(pii.redacted(F.col("text"), spans)).collect()]
    assert got == ["mail <email>, ip <ip>!", "é 𝒳 <phone>", "clean"]


def test_licenses(docs, nothing, spark):
    got = licenses.license_scan(docs).collect()
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    assert bag((r["doc_id"], r["n_words"]) for r in got) == bag((d, len(words.findall((x or "").translate(lower)))) for d, x in ROWS)
    r = next(r for r in got if r["doc_id"] == 10)
    assert tuple(r)[2:] == (2, 3, 8, "gpl,mit", "gpl,mit", 1.0)
    assert {r["labels"] for r in got if r["doc_id"] != 10} == {""}
    assert licenses.license_scan(nothing).count() == 0
    bsd = next(t for label, t in licenses.TEMPLATES if label == "bsd")
    torn = bsd.replace("in source and", "as source code and").replace("are permitted", "is permitted")
    rows = [(1, "some words before " + torn + " and after"), (2, " ".join(bsd.split()[:6])), (3, bsd), (3, bsd)]
    found = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert bag((r["doc_id"], r["labels"]) for r in found) == [(1, "bsd"), (2, ""), (3, "bsd"), (3, "bsd")]
    assert all(r["score"] == 1 for r in found if r["doc_id"] == 3)


def test_fingerprints(docs, nothing, spark):
    got = fingerprints.fingerprints(docs).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, (d, x) in enumerate(order):
        x, y = x or "", order[(i + 1) % len(order)][1] or ""
        new = fingerprints.edited(x, y)
        want.append((d, len(x), hashlib.sha256(new.encode()).hexdigest(), fingerprints.digest(x.encode()), fingerprints.digest(new.encode())))
    assert bag(tuple(r)[:5] for r in got) == bag(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.fingerprints(nothing).count() == 0
    sparse = spark.createDataFrame([(i * i * 1000 - 5, f"text {i} " * 9) for i in range(70)], "doc_id long, text string")
    rows = sorted(fingerprints.fingerprints(sparse).collect())
    texts = [r["text"] for r in sorted(sparse.collect())]
    for i, r in enumerate(rows):
        assert r["edited_sha256"] == hashlib.sha256(fingerprints.edited(texts[i], texts[(i + 1) % 70]).encode()).hexdigest()


def test_fingerprints_of_far_hot_and_missing_ids(spark):
    ids = [-9 * 10 ** 18, 1, 9 * 10 ** 18, *[None] * 40, *[5] * 40, *range(10, 60)]
    rows = [(d, f"text {i:03d} " * 7) for i, d in enumerate(ids)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    want = [(d, hashlib.sha256(fingerprints.edited(x, order[(i + 1) % len(order)][1]).encode()).hexdigest()) for i, (d, x) in enumerate(order)]
    assert bag((r["doc_id"], r["edited_sha256"]) for r in got) == bag(want)


def test_severity_on_held_out_rows(spark, docs, nothing):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        grade = int(rng.integers(0, 4))
        bad = [f"bad{j}" for j in rng.integers(0, 5, grade * 2)]
        rows.append((i, " ".join([*bad, *(f"w{j}" for j in rng.integers(0, 200, 40))])))
        labels.append((i, grade))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    graded = spark.createDataFrame(labels, "doc_id long, grade int")
    model = toxicity.fitted_model(df, graded.filter("doc_id < 400"), "grade")
    assert len(model["thresholds"]) == 3 and (np.diff(model["thresholds"]) > 0).all()
    got = {r["doc_id"]: r["severity"] for r in toxicity.with_severity(df, model).collect()}
    held = [(got[i], g) for i, g in labels if i >= 400]
    assert np.mean([s["toxic"] == (g > 0) for s, g in held]) > 0.97
    assert np.corrcoef([s["expected"] for s, _ in held], [g for _, g in held])[0, 1] > 0.9
    scored = toxicity.with_severity(docs, model)
    assert scored.columns == [*docs.columns, "severity"] and scored.count() == len(ROWS)
    empty = toxicity.fitted_model(nothing, graded, "grade")
    assert not any(r["severity"]["toxic"] for r in toxicity.with_severity(docs, empty).collect())


def test_pseudo_likelihood_beats_word_shares(spark, docs, nothing):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(150):
        words = [int(rng.integers(0, 20))]
        for _ in range(400):
            words.append((words[-1] * 3 + 1) % 20 if rng.random() < 0.9 else int(rng.integers(0, 20)))
        rows.append((i, " ".join(f"w{w}" for w in words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    held = rows[:10]
    shuffled = [(1000 + i, " ".join(rng.permutation(t.split()))) for i, t in held]
    both = df.unionByName(spark.createDataFrame(shuffled, "doc_id long, text string"))
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in lm_scoring.scores(both).collect()}
    assert all(got[i] > got[1000 + i] + 0.1 for i, _ in held)
    odd = lm_scoring.scores(docs).collect()
    assert len(odd) == len(ROWS) and all((r["n_tokens"] == 0) == (r["mean_log_likelihood"] is None) for r in odd)
    assert lm_scoring.scores(nothing).count() == 0


def test_words_outside_the_table_are_scored_by_their_counts(spark, monkeypatch):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(i % 50, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(80)] + [(None, None), (3, "once")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = bag(lm_scoring.scores(texts).collect())
    monkeypatch.setattr(lm_scoring, "TABLE", 20)
    got = bag(lm_scoring.scores(texts).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(abs(a[2] - b[2]) < 1e-5 for a, b in zip(got, want))


def test_tasks_weigh_by_all_the_tokens_they_saw(spark):
    texts = [("a b c d " * 600_000,), ("a c b b d " * 240_000,)]
    frames = (spark.createDataFrame(spark.sparkContext.parallelize(x, len(x)), "text string") for x in (texts[:1], texts[1:], texts))
    shares = np.full(lm_scoring.CLASSES, 1 / lm_scoring.CLASSES)
    first, second, both = (lm_scoring.trained(x, list("abcd"), shares) for x in frames)
    for x, y, mean in zip(first, second, both):
        assert np.allclose(mean, (2 * x + y) / 3, atol=1e-4)
