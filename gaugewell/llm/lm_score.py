"""Language-model scoring: cross-entropy difference of two matched n-gram models.

A target model (documents that ``target_ids`` names) and a background model share one
vocabulary: every word of the corpus. The background is a sample of all documents, in the
order of a hash of id and text, of as many tokens as the target has: both models are made
alike from as much text, so neither gains by its size, and where target and background
are one distribution their losses agree in the mean. A third model of all documents gives
``corpus_loss``. All are bigram models with a Dirichlet prior of PRIOR times the unigrams,
which have ADDED for every word:

    p(w) = (n(w) + ADDED) / (N + ADDED V)        p(w | c) = (n(c w) + PRIOR p(w)) / (n(c) + PRIOR)

c is the word before, or the start; a text's end is an event that follows its last word and
isn't scored. A document's own counts are left out of every model that it is part of. Its
score is the mean over its tokens of -log p_target + log p_background: the lower, the closer
to the target.

Words and pairs of words are counted over all documents under keys of a hash, whose width
grows with the corpus (BITS; at least LEAST_BITS): a share of some 2**-BITS_OVER of the keys
is shared with another. Texts are read once, into chunks of numbered words. Each chunk asks
each range of keys, in which the counts of all chunks meet, for the sums of its own keys;
the answers meet the chunk, whose documents are then scored. The ranges' number grows with
the corpus, their size doesn't.

Words are runs of characters other than ASCII white space, in lower case, without the
MARKS around them. Defined results: a text without words (or null) has no tokens and null
losses; rows that repeat are counted as often; rows whose id the target names are in the
target, all of them; without target documents both models are uniform and scores are 0; an
empty table gives an empty result; only the named columns are read. A text is held whole
by one task, at some 200 bytes a character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.common import bounded_batches, texts_of
from gaugewell.llm.near_dups import _mix, groups_in, word_hashes
from gaugewell.sources.shared import materialise

ADDED = 0.5
PRIOR = 4.0
MARKS = ".,;:!?\"'()[]{}<>|*#%&$"
#: Characters and texts of a chunk; a longer text is a chunk of its own.
CHUNK_CHARS = 5_000_000
CHUNK_TEXTS = 20_000
#: Tokens of the corpus for each range of keys, and the keys' width.
RANGE_TOKENS = 2_000_000
BITS_OVER, LEAST_BITS = 14, 44
#: Width of the documents' hash, and of the histogram's cells that find the sample's end.
ORDER_BITS, CELL_BITS = 62, 16

_U = np.uint64
_PAIR = _U(0xD1342543DE82EF95)
_START = _U(0x9E3779B97F4A7C15)
_IS_MARK = np.isin(np.arange(256), list(MARKS.encode()))


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words, one after another, and where each text's begin (one more entry than texts)."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
    hashes, places = word_hashes(b"\n".join(raw), _IS_MARK)
    return hashes, np.searchsorted(places, offsets)


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers, byte after byte of all of them, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Keys in order."""
    return _pack(np.diff(keys, prepend=_U(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


def coded(docs: DataFrame) -> DataFrame:
    """Chunks of rows (id, text, u): ids, u and numbers of tokens, the hashes of the chunk's words in order, and the tokens by the word's place there."""

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        ids, us, texts, size = [], [], [], 0

        def row():
            hashes, starts = words_of(texts)
            words, tokens = np.unique(hashes, return_inverse=True)
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids, us, np.diff(starts).tolist())]
            return pa.RecordBatch.from_arrays([pa.array([chunk]), *lists, pa.array([_pack_keys(words)], pa.binary()), pa.array([_pack(tokens)], pa.binary())], names=["chunk", "ids", "u", "n", "words", "tokens"])

        for batch in batches:
            for i, t, u in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist()):
                if texts and (size + len(t) > CHUNK_CHARS or len(texts) == CHUNK_TEXTS):
                    yield row()
                    chunk, ids, us, texts, size = chunk + 1, [], [], [], 0
                ids.append(i)
                us.append(u)
                texts.append(t)
                size += len(t)
        if texts:
            yield row()

    return docs.mapInArrow(run, "chunk long, ids array<long>, u array<long>, n array<long>, words binary, tokens binary")


def sample_end(docs: DataFrame, tokens: int) -> int:
    """The u below which the documents (u, n) have about so many tokens: exact to a cell of a cell of the histogram."""
    low, left = 0, tokens
    for level in (1, 2):
        shift = ORDER_BITS - level * CELL_BITS
        part = docs.where((F.col("u") >= low) & (F.col("u") < low + (1 << (shift + CELL_BITS))))
        cells = part.groupBy(F.shiftright("u", shift).alias("c")).agg(F.sum("n").alias("n")).orderBy("c").collect()
        for c, n in cells:
            if n >= left:
                low = c << shift
                break
            left -= n
        else:
            return 1 << ORDER_BITS
    return low + (1 << shift)


class Chunk:
    """The words and pairs of a row of coded(), by keys of a width; which documents the target and the sample have."""

    def __init__(self, row: dict, chosen: list[int], end: int, bits: int):
        self.ids, self.n = row["ids"], np.array(row["n"], dtype=np.int64)
        words, tokens = _unpack_keys(row["words"]), _unpack(row["tokens"]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.first = np.diff(self.doc, prepend=-1) != 0
        self.part = [np.zeros(len(self.n), dtype=bool), np.array(row["u"], dtype=np.int64) < end, np.ones(len(self.n), dtype=bool)]
        self.part[0][chosen] = True
        before = np.where(self.first, 0, np.concatenate(([0], tokens[:-1] + 1))) if len(tokens) else tokens
        cells, cell = np.unique(before * max(len(words), 1) + tokens, return_inverse=True)
        shift = _U(64 - bits)
        contexts = np.concatenate(([_START], words))
        pairs = _mix(contexts[cells // max(len(words), 1)] * _PAIR + words[cells % max(len(words), 1)]) >> shift if len(cells) else np.zeros(0, dtype=np.uint64)
        self.keys = [None, None]
        self.keys[0], of_word = np.unique(words >> shift, return_inverse=True)
        self.keys[1], of_cell = np.unique(pairs, return_inverse=True)
        #: Of each token, the number of its word's key and its pair's.
        self.at = [of_word[tokens], of_cell[cell]]

    def counts(self, kind: int) -> list[np.ndarray]:
        """By key, in each model."""
        return [np.bincount(self.at[kind][p[self.doc]], minlength=len(self.keys[kind])) for p in self.part]

    def own(self, kind: int) -> np.ndarray:
        """How often each token's key occurs in its document."""
        _, which, n = np.unique(self.doc * max(len(self.keys[kind]), 1) + self.at[kind], return_inverse=True, return_counts=True)
        return n[which]

    def losses(self, sums: list[list[np.ndarray]], totals: list[tuple[int, int]], size: int) -> list[np.ndarray]:
        """Each document's loss in each model. sums: by kind and model; totals: tokens and documents that have any; size: of the vocabulary."""
        word, pair = self.own(0), self.own(1)
        before = np.concatenate(([0], self.at[0][:-1])) if len(word) else self.at[0]
        own_before = np.where(self.first, 1, np.concatenate(([1], word[:-1]))) if len(word) else word
        out = []
        for m, (tokens, documents) in enumerate(totals):
            inside = self.part[m][self.doc]
            p1 = (sums[0][m][self.at[0]] - inside * word + ADDED) / (tokens - inside * self.n[self.doc] + ADDED * size)
            context = np.where(self.first, documents, sums[0][m][before]) - inside * own_before
            p = (sums[1][m][self.at[1]] - inside * pair + PRIOR * p1) / (context + PRIOR)
            out.append(np.bincount(self.doc, weights=-np.log(p), minlength=len(self.n)) / np.maximum(self.n, 1))
        return out


_ASKED = "range long, chunk long, keys binary, target binary, sample binary, corpus binary"
_ANSWER = "chunk long, range long, target binary, sample binary, corpus binary, size long"
_MODELS = ["target", "sample", "corpus"]


def _whole_chunks(batches):
    """Rows of whole chunks: the row of coded(), its target positions, and its answers."""
    for table, start in groups_in(batches):
        for i, j in zip(start.tolist(), [*start[1:].tolist(), table.num_rows]):
            if j > i:
                rows = table.slice(i, j - i).to_pylist()
                chosen = [p for r in rows for p in r["chosen"] or ()]
                yield next(r for r in rows if r["words"] is not None), chosen, [r for r in rows if r["range"] is not None]


def _asked(chunks: DataFrame, end: int, bits: int, range_bits: int) -> DataFrame:
    """What the chunks ask each range: their keys there, and their counts in each model. Ranges of words have numbers below 0."""

    def run(batches):
        for row, chosen, _ in _whole_chunks(batches):
            chunk = Chunk(row, chosen, end, bits)
            for kind in (0, 1):
                keys, counts = chunk.keys[kind], chunk.counts(kind)
                ranges = (keys >> _U(bits - range_bits)).astype(np.int64)
                cut = np.flatnonzero(np.diff(ranges, prepend=-1)).tolist()
                numbers = [int(ranges[i]) if kind else -1 - int(ranges[i]) for i in cut]
                spans = list(zip(cut, [*cut[1:], len(keys)]))
                for a in range(0, len(spans), 64):
                    some = spans[a : a + 64]
                    columns = [[_pack_keys(keys[i:j]) for i, j in some], *[[_pack(c[i:j]) for i, j in some] for c in counts]]
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[a : a + 64], pa.int64()), pa.array([row["chunk"]] * len(some), pa.int64()), *[pa.array(c, pa.binary()) for c in columns]], names=["range", "chunk", "keys", *_MODELS])

    return chunks.mapInArrow(run, _ASKED)


def _answers(asked: DataFrame) -> DataFrame:
    """For each row of _asked() the sums over all chunks; and for each range of words a row of their number."""

    def run(batches):
        for table, start in groups_in(batches):
            for i, j in zip(start.tolist(), [*start[1:].tolist(), table.num_rows]):
                if j == i:
                    continue
                group = table.slice(i, j - i)
                keys = [_unpack_keys(k) for k in group.column("keys").to_pylist()]
                ends = np.cumsum([0] + [len(k) for k in keys]).tolist()
                distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
                sums = []
                for m in _MODELS:
                    each = np.concatenate([_unpack(c) for c in group.column(m).to_pylist()])
                    sums.append(np.bincount(which, weights=each.astype(np.float64), minlength=len(distinct)).astype(np.uint64)[which])
                number = group.column("range")[0].as_py()
                of_words = [len(distinct)] if number < 0 else []
                packed = [[_pack(s[a:b]) for a, b in zip(ends, ends[1:])] + [None] * len(of_words) for s in sums]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group.column("chunk").to_pylist() + [None] * len(of_words), pa.int64()), pa.array([number] * (len(keys) + len(of_words)), pa.int64()), *[pa.array(p, pa.binary()) for p in packed], pa.array([None] * len(keys) + of_words, pa.int64())],
                    names=["chunk", "range", *_MODELS, "size"],
                )

    return asked.repartition("range").sortWithinPartitions("range").mapInArrow(run, _ANSWER)


def _scored(chunks: DataFrame, id_col: str, end: int, bits: int, totals: list[tuple[int, int]], size: int) -> DataFrame:
    def run(batches):
        for row, chosen, answers in _whole_chunks(batches):
            chunk = Chunk(row, chosen, end, bits)
            sums = []
            for kind in (0, 1):
                mine = sorted((r for r in answers if (r["range"] >= 0) == bool(kind)), key=lambda r: abs(r["range"] + (not kind)))
                sums.append([np.concatenate([np.zeros(0), *[_unpack(r[m]) for r in mine]]).astype(np.float64) for m in _MODELS])
            some = chunk.n > 0
            target, sample, corpus = (pa.array(x, mask=~some) for x in chunk.losses(sums, totals, size))
            score = pc.subtract(target, sample)
            yield pa.RecordBatch.from_arrays([pa.array(chunk.ids, pa.int64()), pa.array(chunk.n), target, sample, score, corpus], names=[id_col, "n_tokens", "target_loss", "background_loss", "score", "corpus_loss"])

    return chunks.mapInArrow(run, f"`{id_col}` long, n_tokens long, target_loss double, background_loss double, score double, corpus_loss double")


def score(df: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, target_loss, background_loss, score, corpus_loss. target_ids: one column, the ids of target documents."""
    bounded_batches(df.sparkSession)
    id_, text = F.col(id_col).cast("long"), F.col(text_col)
    docs = df.select(id_.alias("id"), text.alias("text"), F.shiftrightunsigned(F.xxhash64(id_, text), 64 - ORDER_BITS).alias("u"))
    texts = materialise(coded(docs), "lm-chunks")
    each = texts.select("chunk", F.posexplode(F.arrays_zip("ids", "u", "n"))).select("chunk", "pos", "col.ids", "col.u", "col.n")
    wanted = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("t_id")).where("t_id IS NOT NULL").distinct()
    named = each.join(wanted.hint("merge"), F.col("ids") == F.col("t_id"), "left_semi")
    chosen = materialise(named.groupBy("chunk").agg(F.collect_list("pos").alias("chosen"), F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("some")), "lm-target")

    sizes = lambda rows: tuple(x or 0 for x in rows.agg(F.sum("n"), F.count_if(F.col("n") > 0)).first())
    target = tuple(x or 0 for x in chosen.agg(F.sum("n"), F.sum("some")).first())
    end = sample_end(each.select("u", "n"), target[0]) if target[0] else 0
    corpus, sample = sizes(each), sizes(each.where(F.col("u") < end))
    bits = min(63, max(LEAST_BITS, corpus[0].bit_length() + BITS_OVER))
    range_bits = max(0, (corpus[0] // RANGE_TOKENS).bit_length())

    none = lambda names, kind: [F.lit(None).cast(kind).alias(n) for n in names]
    rows = texts.select("chunk", "ids", "u", "n", "words", "tokens", *none(["chosen"], "array<int>"), *none(["range"], "long"))
    rows = rows.unionAll(chosen.select("chunk", *none(["ids", "u", "n"], "array<long>"), *none(["words", "tokens"], "binary"), "chosen", *none(["range"], "long")))
    whole = rows.repartition("chunk").sortWithinPartitions("chunk")
    answers = materialise(_answers(_asked(whole, end, bits, range_bits)), "lm-counts")
    size = answers.agg(F.sum("size")).first()[0] or 1
    rows = rows.select("*", *none(_MODELS, "binary"))
    back = answers.where("chunk IS NOT NULL").select("chunk", *none(["ids", "u", "n"], "array<long>"), *none(["words", "tokens"], "binary"), *none(["chosen"], "array<int>"), "range", *_MODELS)
    return _scored(rows.unionAll(back).repartition("chunk").sortWithinPartitions("chunk"), id_col, end, bits, [target, sample, corpus], size)
