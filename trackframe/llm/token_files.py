"""Token ids in binary files of patched frame-of-reference blocks.

Documents are dealt into ranges of their order, each task encodes its range and cuts it into shards of whole
documents, and every shard becomes one file. A shard holds, all little-endian:

    magic "PFR1", part u32, shard u32, before u64, ids u64, documents u32, blocks u32
    document ids i64 each, one bit each where the id is null, their numbers of tokens u32 each
    block index: where each block starts in the body, u32 each, and where the last one ends
    body: blocks of BLOCK ids

A block is its minimum (u32), a width (u8, then one unused byte), its number of exceptions (u16), the differences
to the minimum packed at that width, and the exceptions: places (u16) and differences (u32). The width is the one
that covers one of PERCENTILES of the differences, whichever makes the block smallest. Differences that need more
bits are the exceptions; they are packed as 0 and patched from the list. The last block is filled up with its
last id. `before` counts the ids of earlier shards of the same part; parts follow each other by number, so the
reader needs one total per part to give every document its start.

The files are written by Spark's text writer, one shard a file (it ends each with a line feed, which is no part of
the shard), and read as binary files, so that they may lie wherever Spark can write.
"""

from __future__ import annotations

import itertools
import json
import re
import string
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from trackframe.llm.texts import BYTE_LETTERS, MARKS, letters_of, partitions_of, text_of
from trackframe.session import checkpoint_dir, cut_lineage

BLOCK = 1024
LANES = 16                      # a packed word holds values of one lane
PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.99, 1.0)
SHARD_IDS = 1 << 21             # a shard is closed when it has as many ids,
SHARD_DOCS = 1 << 16            # or as many documents
HEAD = struct.Struct("<4sIIQQII")
BLOCK_HEAD = struct.Struct("<IBxH")
MAGIC = b"PFR1"

CACHED = 800_000                # pieces a worker keeps
LONGEST_KEY = 64
JOINED = 64                     # words the model gets at once
GROUP = 1 << 23                 # bytes of texts that are cut at once

# What a byte of UTF-8 is: the start of what is surely no white space, a visible ASCII character, an ASCII letter,
# an ASCII mark, the first of the two bytes of U+00C0 to U+017F (letters, but for two signs)
STARTS, SHOWN, LETTER, MARK, LEADS = 1, 2, 4, 8, 16
KINDS = np.zeros(256, np.uint8)
for _first, _last in ((0x21, 0x7E), (0xC3, 0xE0), (0xE4, 0xED), (0xF0, 0xF4)):  # white space: C2, E1 to E3
    KINDS[_first:_last + 1] |= STARTS
KINDS[0x21:0x7F] |= SHOWN
KINDS[list(string.ascii_letters.encode())] |= LETTER
KINDS[list(MARKS.encode())] |= MARK
KINDS[0xC3:0xC6] |= LEADS
WORD = re.compile(rb" ?(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|[\xC4\xC5][\x80-\xBF])+")  # of the same letters

_workers: dict = {}


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


_SHORT = _bit_lengths(np.arange(1 << 16))


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Blocks (rows of BLOCK values below 2 ** width) as rows of LANES * width 64-bit words."""
    v = values.reshape(len(values), BLOCK // LANES, LANES).astype(np.uint64)
    out = np.zeros((len(values), width, LANES), np.uint64)
    for j in range(BLOCK // LANES):
        word, shift = divmod(j * width, 64)
        out[:, word] |= v[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[:, j] >> np.uint64(64 - shift)
    return out.reshape(len(values), LANES * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = words.reshape(len(words), width, LANES)
    out = np.empty((len(words), BLOCK // LANES, LANES), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK // LANES):
        word, shift = divmod(j * width, 64)
        v = w[:, word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | w[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = v & mask
    return out.reshape(len(words), BLOCK).astype(np.uint32)


def packed_blocks(ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The blocks of ids (unsigned 32 bit) and the start of each in the body, with the end of the last."""
    if not len(ids):
        return [], np.zeros(1, np.uint32)
    n = -(-len(ids) // BLOCK)
    values = np.concatenate([ids, np.full(n * BLOCK - len(ids), ids[-1], np.uint32)]).astype(np.uint32).reshape(n, BLOCK)
    low = values.min(axis=1)
    rest = values - low[:, None]
    bits = _SHORT[rest] if rest.max() < 1 << 16 else _bit_lengths(rest)
    held = np.bincount((np.arange(n)[:, None] * 33 + bits).ravel(), minlength=33 * n).reshape(n, 33).cumsum(axis=1)
    size = np.arange(33) * (BLOCK // 8) + 6 * (BLOCK - held)
    least = np.array([int(np.ceil(p * BLOCK)) for p in PERCENTILES])
    widths = (held[:, None, :] < least[None, :, None]).sum(axis=2)  # of every percentile
    best = np.take_along_axis(size, widths, axis=1).argmin(axis=1)
    width = widths[np.arange(n), best]
    row, place = np.nonzero(bits > width[:, None])
    over = rest[row, place]
    rest[row, place] = 0
    ends = np.searchsorted(row, np.arange(n + 1))
    bodies: list[bytes] = [b""] * n
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        if w:
            for k, words in zip(which, _pack(rest[which], int(w))):
                bodies[k] = words.astype("<u8").tobytes()
    places, over = place.astype("<u2"), over.astype("<u4")
    blocks = []
    for k in range(n):
        a, b = ends[k], ends[k + 1]
        blocks.append(BLOCK_HEAD.pack(int(low[k]), int(width[k]), int(b - a)) + bodies[k]
                      + places[a:b].tobytes() + over[a:b].tobytes())
    return blocks, np.cumsum([0, *map(len, blocks)]).astype("<u4")


def unpacked_blocks(body, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at `starts` (all but its last, where the last block ends), with filling."""
    n = len(starts) - 1
    heads = [BLOCK_HEAD.unpack_from(body, int(s)) for s in starts[:-1]]
    low = np.array([h[0] for h in heads], np.uint32)
    width = np.array([h[1] for h in heads], np.int64)
    out = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            which = np.flatnonzero(width == w)
            words = np.stack([np.frombuffer(body, "<u8", LANES * int(w), int(starts[k]) + BLOCK_HEAD.size) for k in which])
            out[which] = _unpack(words, int(w))
    for k, (_, w, m) in enumerate(heads):
        if m:
            at = int(starts[k]) + BLOCK_HEAD.size + w * (BLOCK // 8)
            out[k, np.frombuffer(body, "<u2", m, at)] = np.frombuffer(body, "<u4", m, at + 2 * m)
    return (out + low[:, None]).ravel()


def shard_image(part: int, shard: int, before: int, docs: list, lengths: list, ids: np.ndarray) -> bytes:
    blocks, starts = packed_blocks(ids)
    known = np.array([0 if d is None else d for d in docs], "<i8")
    null = np.packbits(np.array([d is None for d in docs], bool))
    return b"".join([HEAD.pack(MAGIC, part, shard, before, len(ids), len(docs), len(blocks)), known.tobytes(),
                     null.tobytes(), np.array(lengths, "<u4").tobytes(), starts.tobytes(), *blocks])


class Shard:
    """A shard file's parts; ids are unpacked when asked for."""

    def __init__(self, image):
        magic, self.part, self.number, self.before, self.n_ids, n_docs, n_blocks = HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at = HEAD.size
        docs = np.frombuffer(image, "<i8", n_docs, at).tolist()
        at += 8 * n_docs
        null = np.unpackbits(np.frombuffer(image, np.uint8, -(-n_docs // 8), at), count=n_docs)
        at += -(-n_docs // 8)
        self.docs = [None if missing else d for d, missing in zip(docs, null)]
        self.lengths = np.frombuffer(image, "<u4", n_docs, at).astype(np.int64)
        at += 4 * n_docs
        self.index = np.frombuffer(image, "<u4", n_blocks + 1, at)
        self.body = memoryview(image)[at + 4 * (n_blocks + 1):]

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """ids from start to end of the shard; only the blocks that hold them are read."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-end // BLOCK)
        return unpacked_blocks(self.body, self.index[first:last + 1])[start - first * BLOCK:end - first * BLOCK]


def border_of(made: dict) -> bytes | None:
    """A control character that the model (given as its file) of a byte-level tokenizer joins with nothing, so that
    words on both sides of it get the ids they get alone."""
    model = made["model"]
    if model["type"] != "BPE" or any(model.get(k) for k in ("ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    joined = set().union(*(token for token in model["vocab"] if len(token) > 1))
    return next((bytes([b]) for b in range(32) if (x := chr(BYTE_LETTERS[b])) in model["vocab"] and x not in joined), None)


class PieceIds:
    """Ids, as little-endian bytes, of pieces of texts (UTF-8).

    A piece that is one word of letters, with or without a space in front, goes to the model without the
    tokenizer's own cutting, many such words at once with `border` between them; everything else goes through the whole
    tokenizer. When half of what may be kept has been added, what was not met since the last such moment is given up.
    """

    def __init__(self, tokenizer, kind: str, cached: int, border: bytes | None = None):
        self.tokenizer, self.kind, self.half, self.border = tokenizer, kind, cached // 2, border
        self.kept: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.part = tokenizer.model.tokenize
        self.border_id = None if border is None else tokenizer.token_to_id(letters_of(border))

    def encode(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def words(self, words: list[bytes]) -> list[bytes]:
        """Of pieces that are words of letters."""
        if self.border is None:
            return [array(self.kind, [t.id for t in self.part(letters_of(w))]).tobytes() for w in words]
        out = array(self.kind)
        for k in range(0, len(words), JOINED):
            out.extend([t.id for t in self.part(letters_of(self.border.join([*words[k:k + JOINED], b""])))])
        size, raw = out.itemsize, out.tobytes()
        stops = np.flatnonzero(np.frombuffer(raw, f"u{size}") == self.border_id) * size
        return [raw[a:b] for a, b in zip([0, *(stops + size).tolist()], stops.tolist())]

    def of(self, pieces: list[bytes]) -> list[bytes]:
        """Of distinct pieces."""
        ids = list(map(self.kept.get, pieces))
        added = [k for k, known in enumerate(ids) if known is None]
        words = []
        for k in added:
            ids[k] = self.old.get(pieces[k])
            if ids[k] is None:
                if WORD.fullmatch(pieces[k]):
                    words.append(k)
                else:
                    ids[k] = self.encode(pieces[k].decode())
        for k, known in zip(words, self.words([pieces[k] for k in words])):
            ids[k] = known
        for k in added:
            if len(pieces[k]) <= LONGEST_KEY:
                self.kept[pieces[k]] = ids[k]
        if len(self.kept) >= self.half:
            self.old, self.kept = self.kept, {}
        return ids


def cut_places(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where texts (UTF-8, one behind the other, the places of their ends) may be cut, as one boolean a byte.

    Byte-level tokenizers cut a text first, and every border here is one of theirs, whatever stands around it: before
    a space or line feed that is followed by what is no white space, after such a line feed, between a visible
    character and a line feed, and between a letter and a mark. No text is looked at beyond its end.
    """
    kinds = KINDS[data]
    cut = np.zeros(len(data) + 1, bool)
    lines = data == 10
    full = (kinds[1:] & STARTS) > 0
    full = np.append(full, False)
    full[ends[ends > 0] - 1] = False
    cut[:-1] = full & ((data == 32) | lines)
    cut[1:] |= full & lines
    cut[1:-1] |= lines[1:] & ((kinds[:-1] & SHOWN) > 0)
    letter = (kinds & LETTER) > 0
    letter[1:] |= ((kinds[:-1] & LEADS) > 0) & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    cut[1:-1] |= letter[:-1] & ((kinds[1:] & MARK) > 0)
    return cut[:-1]


class TextIds:
    """Ids of whole texts, as little-endian bytes of 2 or 4 each; a worker keeps the pieces it has met.

    The texts of a group are cut at once, and each distinct piece is looked up once. Texts that hold a special
    token's string are one piece, encoded whole; so is every text of a tokenizer that is not byte-level.
    """

    def __init__(self, path: str, cached: int = CACHED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        cutter = made.get("pre_tokenizer") or {}
        self.whole = not (made.get("normalizer") is None and cutter.get("type") == "ByteLevel"
                          and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
                          and made["model"]["type"] == "BPE" and not made["model"].get("dropout"))
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        border = None if self.whole else border_of(made)
        self.bare = PieceIds(self.tokenizer, self.kind, cached // 4, border)
        self.spaced = PieceIds(self.tokenizer, self.kind, cached, border)  # pieces that start with a space

    def of(self, text: str) -> bytes:
        return self.of_group(pa.array([text]))[0].tobytes()

    def of_group(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) one behind the other, `end` after each, and the place of each text's end."""
        raw = texts.cast(pa.large_binary())
        places = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
        held = pa.py_buffer(b"") if raw.buffers()[2] is None else raw.buffers()[2].slice(places[0], places[-1] - places[0])
        places = places - places[0]
        data = np.frombuffer(held, np.uint8)
        if self.whole:
            cut = np.zeros(len(data), bool)
        else:
            cut = cut_places(data, places[1:])
            for special in self.specials:
                for k in np.flatnonzero(pc.match_substring(texts, special)):
                    cut[places[k]:places[k + 1]] = False
        cut[places[:-1][places[:-1] < places[1:]]] = True
        starts = np.flatnonzero(cut)
        bounds = pa.py_buffer(np.append(starts, len(data)))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, bounds, held]).dictionary_encode()
        met, indices = pieces.dictionary.to_numpy(zero_copy_only=False), pieces.indices.to_numpy()
        spaced = np.zeros(len(met), bool)
        spaced[indices] = data[starts] == 32
        order = np.argsort(~spaced, kind="stable")
        n = np.count_nonzero(spaced)
        ids = pa.array([*self.spaced.of(met[order[:n]].tolist()), *self.bare.of(met[order[n:]].tolist()), end], pa.large_binary())
        rank = np.empty(len(met), np.int64)
        rank[order] = np.arange(len(met))
        which = np.insert(rank[indices], np.searchsorted(starts, places[1:]), len(met))
        ends = np.cumsum(pc.binary_length(ids).to_numpy()[which])[np.flatnonzero(which == len(met))]
        return np.frombuffer(ids.take(pa.array(which)).buffers()[2] or b"", np.uint8)[:ends[-1] if len(ends) else 0], ends


def groups_of(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """First row and row behind the last of neighbouring texts of about `size` bytes together."""
    whole = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // size
    return itertools.pairwise([0, *(np.flatnonzero(np.diff(whole)) + 1).tolist(), len(texts)])


def encoded_shards(docs: DataFrame, tokenizer_path: str, end_id: int, id_column: str = "doc_id", text: str = "text",
                   shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row `image` per shard. Parts are ranges of (id, hash of the text, row), so that rows of one id, and a
    row that is repeated, can be spread."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if _workers.get("path") != tokenizer_path:
            _workers.update(path=tokenizer_path, texts=TextIds(tokenizer_path))
        texts, part = _workers["texts"], TaskContext.get().partitionId()
        end = array(texts.kind, [end_id]).tobytes()
        size = len(end)
        shard = before = n = 0
        held: tuple[list, list, list] = ([], [], [])

        def image():
            ids = np.frombuffer(b"".join(held[2]), f"u{size}").astype(np.uint32)
            made = shard_image(part, shard, before, held[0], held[1], ids)
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["image"])

        for batch in batches:
            for first, last in groups_of(batch.column(1), GROUP):
                names = batch.column(0).slice(first, last - first).to_pylist()
                ids, ends = texts.of_group(batch.column(1).slice(first, last - first), end)
                taken = at = 0
                for name, to in zip(names, ends.tolist()):
                    held[0].append(name)
                    held[1].append((to - at) // size)
                    n, at = n + held[1][-1], to
                    if n >= shard_ids or len(held[0]) >= shard_docs:
                        held[2].append(ids[taken:at])
                        yield image()
                        taken, shard, before, n, held = at, shard + 1, before + n, 0, ([], [], [])
                held[2].append(ids[taken:])
        if held[0]:
            yield image()

    rows = docs.select(F.col(id_column).cast("long").alias("doc"), text_of(text).alias("text")).select(
        "doc", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = ["doc", "hash", "row"]
    return (rows.repartitionByRange(partitions_of(docs.sparkSession), *order).sortWithinPartitions("doc", "hash", "text", "row")
            .select("doc", "text").mapInArrow(encode, "image binary"))


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_column: str = "doc_id",
                    text: str = "text", shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS) -> None:
    """Files of the ids of every whole text, each followed by end_id, in ascending order of the ids of documents.

    A null id comes first; rows that share an id follow each other by hash of the text, then text. A null or
    empty text is end_id alone. Special tokens' strings are handled as the tokenizer does by default. An empty
    table gives no shards. Other columns are not read.
    """
    images = encoded_shards(docs, tokenizer_path, end_id, id_column, text, shard_ids, shard_docs)
    images.select(F.col("image").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def shards_of(spark: SparkSession, path: str) -> DataFrame:
    """path and content of every file with a shard; tasks that had no rows may have left empty files."""
    return spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens (with the end
    id), ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                shard = Shard(content.as_buffer())
                raw = memoryview(shard.ids().astype("<u4").tobytes())
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ends), shard.part)), pa.array(shard.docs, pa.int64()),
                     pa.array(starts + shard.before), pa.array(shard.lengths), pa.array(sums, pa.int64())],
                    ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = cut_lineage(shards_of(spark, path).select("content").mapInArrow(
        read, "part long, doc_id long, start long, n_tokens long, ids_crc32 long"))
    totals = sorted(rows.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens"))).collect())  # a row per part written
    before = itertools.accumulate((n for _, n in totals), initial=0)
    bases = spark.createDataFrame([(part, b) for (part, _), b in zip(totals, before)], "part long, base long")
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Writes the files under the shared checkpoint folder and reads them back, one row per document."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_ids(docs, path, tokenizer_path, end_id)
    return read_token_ids(spark, path)
