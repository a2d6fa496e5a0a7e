"""The pipeline's stages against plain versions, and registered SQL."""

import collections
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.brute import jaccard_components, personal_spans
from tests.oracle import compare, connect
from trackframe.llm import ngram_join, toxicity
from trackframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF) == ""


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before the first stage and after each."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
    return out


def test_all_stages_but_the_last_return_documents(stages):
    for rows in stages[1:-1]:
        assert rows and list(rows[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_rows_go(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fitted_model(spark.read.parquet(f"{SF}/documents.parquet"), labels, "toxic", refine=2)
    stay = []
    for r in stages[0]:
        columns, values = toxicity.features(r["text"], model["index"])
        score = float(np.dot(values, model["weights"][columns])) if columns else 0.0
        if toxicity.grade_shares(score, model["thresholds"])[0] > 0.5:
            stay.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[1]) == sorted(stay) and len(stay) < len(stages[0])


def test_one_document_of_each_group_stays(stages):
    want = {d for d, _, c in jaccard_components([(r["doc_id"], r["text"]) for r in stages[1]], 5, 80, 100) if d == c}
    assert {r["doc_id"] for r in stages[2]} == want


def test_leaking_documents_go(spark, stages):
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaking = {r["doc_id"] for r in stages[2] if any(i in words(r["text"]) for i in items)}
    assert leaking and {r["doc_id"] for r in stages[3]} == {r["doc_id"] for r in stages[2]} - leaking


def test_personal_data_is_masked_and_the_rest_kept(stages):
    before = {r["doc_id"]: r for r in stages[3]}
    assert {r["doc_id"] for r in stages[4]} == set(before)
    for r in stages[4]:
        old = before[r["doc_id"]]["text"]
        assert not personal_spans(r["text"]) and (r["n_chars"] == len(r["text"]) or r["text"] == old)
        if not personal_spans(old) and "<key>" not in r["text"]:
            assert r["text"] == old


def test_every_id_is_packed_once(stages):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    held = collections.defaultdict(int)
    for r in stages[5]:
        held[r["doc_id"]] += r["length"]
    assert held == {r["doc_id"]: len(t.encode(r["text"] or "", add_special_tokens=False)) + 1 for r in stages[4]}


def test_stages_stand_empty_tables_and_nulls(spark, docs, nothing):
    from pyspark.sql import functions as F
    empty = nothing.select("doc_id", "text", F.lit("").alias("lang"), F.lit("").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    some = docs
    for name in ("_severity", "_row", "row", "_id", "_key", "_added", "_spans", "_gone", "_again", "_n", "_first", "c3", "id", "first", "n_shingles"):
        some = some.withColumn(name, F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        got = stage(spark, some, SF)
        rows = got.collect()
        assert rows
        if name != "packing":
            assert got.columns == some.columns and all(r["_id"] == r["_row"] == r["c3"] == r["_spans"] == r["_n"] == "mine" for r in rows)


def test_different_texts_of_one_id_stay(spark):
    said = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(7, None), (7, said("a")), (7, said("b")), (7, said("b")), (None, said("c")), (None, said("d")), (9, said("a")), (3, said("d")),
            (None, None), (8, "")]
    got = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[i] for i in (0, 1, 2, 4, 7, 8, 9)]))


def test_texts_are_not_shuffled_to_leave_copies_out(spark, monkeypatch):
    said = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(i, said(k), k) for i, k in enumerate("abcabdaae")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __________________w string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (500_000, 0):
            monkeypatch.setattr(ngram_join, "BROADCAST_IDS", most)
            got = corpus_pipeline.one_of_each(spark, docs, SF)
            assert sorted(map(tuple, got.collect())) == [rows[i] for i in (0, 1, 2, 5, 8)]
            if most:
                assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_only_rows_whose_own_text_leaks_go(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 100").orderBy("item_id").first()["text"]
    rows = [(None, "a clean row without id"), (None, f"before it {item} after it"), (5, "a clean row of a repeated id"), (5, item),
            (6, None), (None, None)]
    got = corpus_pipeline.without_leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[0], rows[2], rows[4], rows[5]]))
