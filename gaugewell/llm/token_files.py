"""Token ids in files: frequency-ranked, byte-aligned, control bytes apart, decoded by table lookup.

File format: Parquet rows, one block each, in ascending document order within a shard
and over shards: ``shard``, ``block_start`` (ids before the block in its shard),
``doc_ids``, ``lengths`` (ids of each document), ``control``, ``data``. An id is stored
as its frequency rank (0: the most frequent) in the fewest bytes that hold it, low byte
first, in ``data``; ``control`` has two bits for each id, its length less one, four to a
byte, lowest bits first. ``ranks`` beside the blocks lists the ids by rank.

Defined results: a null text counts as empty; null doc_ids come first; documents with
equal ids follow one another in the order of their coded ids; an empty table gives no
blocks; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.common import ChunkValues, bounded_batches, drops_space, few_at_once, lowers, read_tokenizer, strings, texts_of
from gaugewell.sources.shared import new_path, remove

BLOCK_IDS = 1 << 20
_BYTE = np.arange(4, dtype=np.uint8)
#: Lengths of the four ids that a control byte describes.
LENGTHS = ((np.arange(256)[:, None] >> (2 * _BYTE)) & 3).astype(np.uint8) + 1
_ENCODERS: dict[str, object] = {}


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[: len(values)] = lengths - 1
    control = codes[::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    width = 2 if lengths.max(initial=1) <= 2 else 4
    return control.tobytes(), values.astype(f"<u{width}").view(np.uint8).reshape(-1, width)[_BYTE[:width] < lengths[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values that pack() stored."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    width = 2 if lengths.max(initial=1) <= 2 else 4
    out = np.zeros((n, width), dtype=np.uint8)
    out[_BYTE[:width] < lengths[:, None]] = np.frombuffer(data, dtype=np.uint8)
    return out.view(f"<u{width}").reshape(-1).astype("<u4")


_LETTERS = "[a-z\u00df-\u00f6\u00f8-\u00ff]+"
#: Pre-tokenizer patterns by which a run of letters ends at ASCII punctuation, and a run of that is one piece.
_APART = {"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}


class _Rows:
    """Rows of ids, one after another in one array."""

    def __init__(self, kind: np.dtype):
        self.ids, self.first, self.size = np.zeros(1 << 20, dtype=kind), np.zeros(1 << 18, dtype=np.int64), np.zeros(1 << 18, dtype=np.int64)
        self.n = self.held = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """The new rows' numbers."""
        n, held = self.n + len(sizes), self.held + len(ids)
        while n > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        while held > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.held : held] = ids
        self.size[self.n : n] = sizes
        self.first[self.n : n] = self.held + np.cumsum(sizes) - sizes
        rows = range(self.n, n)
        self.n, self.held = n, held
        return rows

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows, one after another, and where each row's begin (one more entry than rows)."""
        sizes = self.size[rows]
        at = np.concatenate(([0], np.cumsum(sizes)))
        return self.ids[np.repeat(self.first[rows] - at[:-1], sizes) + np.arange(at[-1])], at


class _ChunkIds(ChunkValues):
    """Ids of texts by rows of their chunks, each encoded once while it is known.

    A word of letters and the ASCII punctuation after it are encoded apart where the
    tokenizer makes them pieces of their own (``tails``); many words of letters go in one
    call, in which each ends with its only end-of-word id.
    """

    def __init__(self, parsed: dict, kind: np.dtype, ids_of, words_of, most: int):
        specials = [t["content"] for t in parsed["added_tokens"]]
        super().__init__(None, lowers(parsed), specials, most)
        # special tokens of letters may lie within words
        self.kind, self.ids_of, self.words_of = kind, ids_of, None if any(map(re.compile(_LETTERS).fullmatch, specials)) else words_of
        pattern = (parsed["pre_tokenizer"].get("pretokenizers") or [parsed["pre_tokenizer"]])[0].get("pattern", {}).get("Regex")
        # punctuation within a special token stays where it is
        self.tails = "".join(c for c in string.punctuation if not any(c in s for s in specials)) if pattern in _APART else ""
        self.rows = _Rows(kind)

    def _add(self, chunks: list[str], encoded: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The numbers of the chunks' new rows."""
        rows = self.rows.add(*encoded)
        self.known.update(zip(chunks, rows))
        return np.arange(rows.start, rows.stop)

    def _words(self, words: list[str]) -> np.ndarray:
        return self._add(words, self.words_of(words) or self._library(words)) if words else np.zeros(0, dtype=np.int64)

    def _library(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        some = self.ids_of(chunks)
        return np.frombuffer(b"".join(some), dtype=self.kind), np.array(list(map(len, some)), dtype=np.int64) // self.kind.itemsize

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Rows for distinct chunks that aren't known."""
        rows, other, ended, cut, tails = np.zeros(len(new), dtype=np.int64), np.ones(len(new), dtype=bool), None, [], []
        if self.words_of:
            bare = pc.utf8_rtrim(new, characters=self.tails) if self.tails else new
            # lower-case letters up to U+024F are left as they are by NFC, and are one word each
            letters = pc.match_substring_regex(bare, f"^{_LETTERS}$").to_numpy(zero_copy_only=False)
            whole = pc.equal(pc.binary_length(bare), pc.binary_length(new)).to_numpy(zero_copy_only=False)
            other, ended = ~letters, letters & ~whole
            rows[letters & whole] = self._words(strings(new.filter(pa.array(letters & whole))))
            cut, stems = strings(new.filter(pa.array(ended))), strings(bare.filter(pa.array(ended)))
            self._words(list({w for w in stems if w not in self.known}))
            tails = [c[len(w) :] for c, w in zip(cut, stems)]
        rest = strings(new.filter(pa.array(other)))
        n = len(rest)
        rest += set(tails).difference(self.known, rest)
        if rest:
            rows[other] = self._add(rest, self._library(rest))[:n]
        if cut:
            ids, at = self.rows.take(np.array([self.known[x] for pair in zip(stems, tails) for x in pair], dtype=np.int64))
            rows[ended] = self._add(cut, (ids, np.diff(at[::2])))
        return rows

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after another, and where each text's begin (one more entry than texts)."""
        if len(self.known) > self.most:
            self.known, self.rows = {}, _Rows(self.kind)
        values, which, starts = self.split(texts)
        chunks = strings(values)
        rows = np.fromiter(map(self.known.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(rows < 0)
        if len(new):
            # the empty chunk, before leading and after trailing white space, has no ids
            rows[new] = self._learn(values.take(pa.array(new)))
        ids, at = self.rows.take(rows[which])
        return ids, at[starts]


def _encoder(spec: str):
    """The kind of ids, their number, and texts -> (ids of all, where each text's begin); kept by the worker from task to task."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key in _ENCODERS:
        return _ENCODERS[key]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tokenizer = Tokenizer.from_str(spec)
    parsed = json.loads(spec)
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    ids_of = lambda texts: [np.array(e.ids, dtype=kind).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        some = ids_of(texts)
        return np.frombuffer(b"".join(some), dtype=kind), np.concatenate(([0], np.cumsum(list(map(len, some)), dtype=np.int64))) // kind.itemsize

    if not drops_space(parsed):
        _ENCODERS[key] = (kind, size, whole)
        return _ENCODERS[key]
    suffix = parsed["model"].get("end_of_word_suffix")
    ends = np.zeros(size, dtype=bool)
    if suffix:
        ends[[i for t, i in tokenizer.get_vocab(True).items() if t.endswith(suffix)]] = True
    bare = Tokenizer.from_str(spec)
    bare.normalizer = normalizers.Sequence([])
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def words_of(words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and sizes of words of letters, None where they can't be told apart."""
        ids = np.array(bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=kind)
        at = np.flatnonzero(ends[ids]) + 1
        return (ids, np.diff(at, prepend=0)) if len(at) == len(words) and at[-1] == len(ids) else None

    _ENCODERS[key] = (kind, size, _ChunkIds(parsed, kind, ids_of, words_of if suffix else None, 800_000).encode)
    return _ENCODERS[key]


def encoded(df: DataFrame, spec: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids), and from each task one of id counts (tokens, counts) in place of ids."""

    def run(batches):
        kind, size, encode = _encoder(spec)
        counts = np.zeros(size, dtype=np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in few_at_once(texts):
                ids, at = encode(texts[a:b])
                if end_id is not None:
                    ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
                counts += np.bincount(ids, minlength=size)
                raw, at = ids.tobytes(), (at * kind.itemsize).tolist()
                some = pa.array([raw[i:j] for i, j in zip(at, at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), some, pa.nulls(b - a, pa.binary())], schema=schema)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], schema=schema)

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, ids binary, counts binary")


def _ranking(enc: DataFrame) -> np.ndarray:
    """Ids by falling count, then rising id. As many rows as the vocabulary has come to the driver, at most."""

    def spread(batches):
        for batch in batches:
            total = sum(np.frombuffer(x, dtype=np.int64) for x in batch.column(0).to_pylist())
            if batch.num_rows:
                ids = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    rows = enc.where("counts IS NOT NULL").select("counts").mapInArrow(spread, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], dtype=np.int64)


def write(df: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the texts with the tokenizers library and write them to path (blocks/ and ranks/)."""
    spark = df.sparkSession
    bounded_batches(spark)
    spec = read_tokenizer(tokenizer)
    size_kind = json.loads(spec)["model"]["vocab"]
    kind = np.dtype("<u2" if len(size_kind) + len(json.loads(spec)["added_tokens"]) <= 1 << 16 else "<u4")
    step = new_path(spark, "ids")
    encoded(df, spec, end_id, id_col, text_col).write.option("compression", "zstd").parquet(step)
    enc = spark.read.schema("doc_id long, ids binary, counts binary").parquet(step)
    by_rank = _ranking(enc)
    rank_of = np.zeros(int(by_rank.max(initial=-1)) + 1, dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def blocks(batches):
        shard, before = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        parts: list[np.ndarray] = []
        held = 0

        def block():
            control, data = pack(rank_of[np.concatenate(parts)])
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "block_start": before, "doc_ids": doc_ids, "lengths": [len(p) for p in parts], "control": control, "data": data}],
                schema=pa.schema([("shard", pa.int32()), ("block_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())]),
            )

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts.append(np.frombuffer(ids.as_buffer(), dtype=kind))
                doc_ids.append(doc_id)
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield block()
                    before, held, doc_ids, parts = before + held, 0, [], []
        if parts:
            yield block()

    ordered = enc.where("ids IS NOT NULL").select("doc_id", "ids").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(blocks, "shard int, block_start long, doc_ids array<long>, lengths array<long>, control binary, data binary").write.option("compression", "none").parquet(f"{path}/blocks")
    ranks = [(r, int(i)) for r, i in enumerate(by_rank)]
    spark.createDataFrame(ranks, "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    remove(spark, step)


def read(spark, path: str) -> DataFrame:
    """Documents of a folder that write() made: doc_id, start (ids before it in all the files), n_tokens, ids (unsigned 32-bit, little-endian)."""
    bounded_batches(spark)
    stored = spark.read.schema("shard int, block_start long, doc_ids array<long>, lengths array<long>, control binary, data binary").parquet(f"{path}/blocks")
    by_rank = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], dtype="<u4")
    # one row per shard; a shard's total is its last block's end
    ends = stored.groupBy("shard").agg(F.max(F.col("block_start") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    offsets, total = {}, 0
    for r in sorted(ends, key=lambda r: r["shard"]):
        offsets[r["shard"]] = total
        total += r["n"]

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], dtype=np.int64)
                ids = by_rank[unpack(row["control"], row["data"], int(lengths.sum()))]
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw = ids.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(offsets[row["shard"]] + row["block_start"] + starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return stored.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of read()'s documents."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
