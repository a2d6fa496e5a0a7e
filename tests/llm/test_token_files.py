"""Files of token ids: exact round trips, and the library's own ids."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import ROWS
from trackframe.llm import token_files as tf

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def expected(rows, path, end):
    """(doc_id, start, n_tokens, crc32) in the order of the files, for rows in that order."""
    t, out, before = Tokenizer.from_file(path), [], 0
    for d, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4")
        out.append((d, before, len(ids), zlib.crc32(ids.tobytes())))
        before += len(ids)
    return out


@pytest.mark.parametrize("top", [1, 2, 300, 50257, 1 << 16, 1 << 32])
@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 70_000])
def test_shard_round_trip(n, top):
    rng = np.random.default_rng(n + top)
    ids = rng.integers(0, top, n).astype(np.uint32)
    ids[rng.random(n) < 0.9] %= 200
    shard = tf.Shard(tf.shard_image(3, 1, 7, [None, -5], [n, 0], ids) + b"\n")
    assert (shard.part, shard.number, shard.before, shard.n_ids, shard.docs) == (3, 1, 7, n, [None, -5])
    assert shard.lengths.tolist() == [n, 0] and (shard.ids() == ids).all()
    for a, b in ((0, 1), (n // 3, n // 2), (n - 1, n + 9), (n, n)):
        assert (shard.ids(max(a, 0), b) == ids[max(a, 0):b]).all()


def test_outliers_go_to_the_exception_list():
    ids = np.full(4 * tf.BLOCK, 1000, np.uint32) + np.arange(4 * tf.BLOCK, dtype=np.uint32) % 16
    ids[::500] = 1 << 31
    blocks, starts = tf.packed_blocks(ids)
    assert starts[-1] == sum(map(len, blocks)) and len(blocks) == 4
    for block in blocks:
        low, width, n = tf.BLOCK_HEAD.unpack_from(block)
        assert (low, width) == (1000, 4) and 2 <= n <= 3 and len(block) == tf.BLOCK_HEAD.size + 4 * 128 + 6 * n


def test_only_blocks_asked_for_are_read():
    ids = np.arange(10 * tf.BLOCK, dtype=np.uint32)
    shard = tf.Shard(tf.shard_image(0, 0, 0, [1], [len(ids)], ids))
    body = bytearray(shard.body)
    body[:shard.index[3]] = bytes(int(shard.index[3]))  # a reader of later blocks never sees the first three
    shard.body = memoryview(bytes(body))
    assert (shard.ids(3 * tf.BLOCK + 5, 5 * tf.BLOCK) == ids[3 * tf.BLOCK + 5:5 * tf.BLOCK]).all()


def test_ids_are_the_library_s():
    texts, t = tf.TextIds(BYTES, cached=40), Tokenizer.from_file(BYTES)
    parts = ["a", "B", "é", "ß", "'s", "'", "n't", "\n", " ", " ", "  ", "\t", "1", "23", ".", ",", "!", "<|endoftext|>", " ",
             "　", "ĉ", "漢", "😀", "\x1c", "\u0085", "\r\n", "Ġ", "-", "ª", "́"]
    rng = random.Random(5)
    for _ in range(4000):
        x = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert np.frombuffer(texts.of(x), "<u2").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)
    long = "\n".join("ab" for _ in range(5000))
    assert np.frombuffer(texts.of(long), "<u2").tolist() == t.encode(long, add_special_tokens=False).ids


def test_letters_before_a_run_of_marks_are_not_cut_again():
    t, texts, met = Tokenizer.from_file(BYTES), tf.TextIds(BYTES, cached=100), []

    class Kept:
        def encode(self, text, **how):
            met.append(text)
            return t.encode(text, **how)

    texts.bare.tokenizer = texts.spaced.tokenizer = Kept()
    text = "ab### cd### \u00e9t\u00e9###, it's' x\nab... don'"
    assert texts.of(text) == np.array(t.encode(text, add_special_tokens=False).ids, "u2").tobytes()
    assert not [m for m in met if "ab" in m or "cd" in m]


def test_new_words_of_a_group_go_to_the_model_together():
    t, texts, met = Tokenizer.from_file(BYTES), tf.TextIds(BYTES), []
    part = texts.spaced.part
    texts.spaced.part = lambda x: met.append(x) or part(x)
    rows = [" ".join(f"{a}w\u00f6{b}rd" for a in "abcdefgh" for b in "qrstuvw"[k:]) + ", " * k for k in range(7)]
    for _ in range(2):
        ids, ends = texts.of_group(pa.array(rows), b"\xff\xff")
        want = [[*t.encode(x, add_special_tokens=False).ids, 0xFFFF] for x in rows]
        assert ids.view("<u2").tolist() == sum(want, []) and (ends // 2).tolist() == np.cumsum([*map(len, want)]).tolist()
        assert len(met) == 1  # 55 distinct words, in one of two passes


@pytest.mark.parametrize("border", [True, False])
def test_texts_are_not_cut_by_their_neighbours(border):
    t, texts = Tokenizer.from_file(BYTES), tf.TextIds(BYTES, cached=40)
    if not border:
        texts.bare.border = texts.spaced.border = None
    parts = ["a", "B", "\u00e9", "\u00d7", "'s", "'", "\n", " ", " ", "  ", "\t", "1", ".", ",", "\x00", "<|endoftext|>", "\u00a0",
             "\u3000", "\u0416", "\u6f22", "\u304b", "\x1c", "\u0085", "\r\n", "\u00aa", "\u0301", "\u00b2"]
    rng = random.Random(6)
    for _ in range(30):
        rows = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(100)]
        ids, ends = texts.of_group(pa.array(["not read", *rows]).slice(1), b"\x07\x00")
        starts = [0, *ends[:-1].tolist()]
        for x, a, b in zip(rows, starts, ends.tolist()):
            assert ids[a:b].view("<u2").tolist() == [*t.encode(x, add_special_tokens=False).ids, 7], repr(x)


def test_a_border_is_joined_with_nothing():
    made = json.loads(Tokenizer.from_file(BYTES).to_str())
    assert tf.border_of(made) == b"\x00"
    made["model"]["vocab"]["\u0100a"] = 60_000  # the vocabulary writes byte 0 as U+0100
    assert tf.border_of(made) == b"\x01"
    made["model"]["ignore_merges"] = True
    assert tf.border_of(made) is None


def test_groups_hold_every_row_once():
    texts = pa.array(["", "abc", "", "d" * 50, "ef", "", "gh"])
    for size in (1, 4, 1000):
        groups = list(tf.groups_of(texts, size))
        assert [k for a, b in groups for k in range(a, b)] == list(range(7))
    assert groups == [(0, 7)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_documents_come_back_in_order(spark, docs, nothing, tmp_path, path):
    def order(row):
        return row[0] is not None, row[0] or 0

    got = sorted(tf.token_ids(docs, path, 7).collect(), key=lambda r: r["start"])
    want = expected(sorted(ROWS, key=order), path, 7)
    assert [tuple(r) for r in got] == want
    assert tf.token_ids(nothing, path).count() == 0
    folder = f"{tmp_path}/{len(path)}"
    tf.write_token_ids(docs, folder, path, 7, shard_ids=50, shard_docs=3)  # many shards: same rows
    assert sorted((tuple(r) for r in tf.read_token_ids(spark, folder).collect()), key=lambda r: r[1]) == want
    assert tf.shards_of(spark, folder).count() > 5


def test_a_hot_id_and_repeated_rows(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"),
                                    F.when(F.col("id") % 3 > 0, F.lit("same text")).otherwise(F.col("id").cast("string")).alias("text"))
    got = sorted((r["start"], r["n_tokens"]) for r in tf.token_ids(rows, BYTES).collect())
    assert len(got) == 3000
    assert [a for a, _ in got] == np.cumsum([0, *[n for _, n in got]])[:-1].tolist()
