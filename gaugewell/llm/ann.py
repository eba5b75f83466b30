"""Approximate nearest neighbours by additive quantisation.

A unit vector is approximated by a sum of CODEBOOKS codewords, one from each of as many
full-dimensional codebooks, found by a beam search that goes from codebook to codebook
with the BEAM best partial sums. The codebooks are fitted on a bounded sample (SAMPLE
vectors, by the smallest hashes): residual k-means, then rounds of beam
encoding and refitting each codebook to what the others leave. The index holds codes
the norms of the sums and the quantisation errors, of every distinct direction with its
k + 1 smallest ids: equal vectors are one row of it. A query is scored against a chunk
of the index through a table of its products with all codewords, divided by the stored
norms. The RERANK best of every chunk are ranked by the cosine of the original vectors
in double precision, which gives the k-th cosine so far; no row's cosine is above its
approximate score by more than its quantisation error, and every row that may still
reach the k-th cosine is ranked too. So every chunk is answered exactly, whatever the
codes don't tell apart; RERANK sets the work, not the result.

Queries meet the index in blocks: a chunk is read once for PART_BLOCKS blocks of queries.
Every query is held against every chunk: what grows with the square of the table is the
lookups and the queries' copies, one for each chunk.

Defined results: vectors that are null, zero, of an unusual length, or hold null or
non-finite components take no part; a null id is no query and no candidate; rows that
share the query's id are its own; rows that share another's id are one candidate, at the
greatest of their cosines, and queries that share an id one query; ties go to the smaller id; an empty table gives an
empty result; only the id and the vector are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.llm.common import by_hash
from gaugewell.llm.near_dups import groups_in
from gaugewell.llm.vectors import matrix, unit, usable
from gaugewell.sources.shared import discard, materialise

CODEBOOKS = 16
WORDS = 256
BEAM = 8
SAMPLE = 4096
ROUNDS = 6
REFITS = 2
CHUNK = 8192
QUERY_BLOCK = 256
#: Blocks of queries that a task takes through a chunk.
PART_BLOCKS = 64
RERANK = 320
#: More than sums of single precision are off by.
ROUNDING = 1e-5


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)


def fit(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Codebooks (CODEBOOKS, words, d) of the rows of x."""
    rnd = np.random.default_rng(seed)
    words = min(WORDS, len(x))
    rest, books = x.copy(), []
    for _ in range(CODEBOOKS):
        c = rest[rnd.choice(len(rest), words, replace=False)].copy()
        for _ in range(ROUNDS):
            at = _nearest(rest, c)
            c = _means(rest, at, c)
        books.append(c)
        rest -= c[_nearest(rest, c)]
    books = np.stack(books)
    for _ in range(REFITS):
        codes = encode(x, books)
        rest = x - sum(books[m][codes[:, m]] for m in range(CODEBOOKS))
        for m in range(CODEBOOKS):
            rest += books[m][codes[:, m]]
            books[m] = _means(rest, codes[:, m], books[m])
            rest -= books[m][codes[:, m]]
    return books


def _means(x, at, c):
    """Means of the rows given to each word; a word without rows stays."""
    n = np.bincount(at, minlength=len(c))
    sums = np.zeros_like(c)
    np.add.at(sums, at, x)
    return np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (n, CODEBOOKS) by beam search."""
    out = []
    for a in range(0, len(x), 256):
        rest = x[a : a + 256, None, :]  # what each partial sum leaves
        error = (rest * rest).sum(axis=2)
        codes = np.zeros((len(rest), 1, 0), dtype=np.uint8)
        for c in books:
            # |r - c|^2 = |r|^2 - 2 r.c + |c|^2
            all_ = error[:, :, None] - 2 * (rest @ c.T) + (c * c).sum(axis=1)
            n, b, w = all_.shape
            flat = all_.reshape(n, b * w)
            k = min(beam, b * w)
            best = np.argpartition(flat, k - 1, axis=1)[:, :k]
            error = np.take_along_axis(flat, best, axis=1)
            from_, word = best // w, best % w
            rows = np.arange(n)[:, None]
            rest = rest[rows, from_] - c[word]
            codes = np.concatenate([codes[rows, from_], word[:, :, None].astype(np.uint8)], axis=2)
        out.append(codes[np.arange(len(rest)), error.argmin(axis=1)])
    return np.concatenate(out) if out else np.zeros((0, len(books)), dtype=np.uint8)


def sums_norm(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    s = sum(books[m][codes[:, m]] for m in range(len(books)))
    return np.sqrt((s * s).sum(axis=1)).astype(np.float32)


def error_bound(x: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray) -> np.ndarray:
    """What a row's approximate score may be off by: the distance to its normalised sum, and the rounding of single precision."""
    norms = np.maximum(norms.astype(np.float64), 1e-12)
    s = sum(books[m][codes[:, m]] for m in range(len(books))) / norms[:, None]
    return np.sqrt(((x - s) ** 2).sum(axis=1)) + ROUNDING * (1 + 1 / norms)


def _cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row, so that a row's value doesn't depend on the rows beside it."""
    return (vectors * query).sum(axis=1)


def search_chunk(queries, query_ids, ids, codes, norms, errors, vectors, books, k, rerank):
    """The k nearest ids in a chunk of each query: (query position, id, cosine). ids: a class's ids in order, (n, k + 1), filled up with the last."""
    tables = np.einsum("qd,mwd->mqw", queries, books).astype(np.float32)
    scores = np.zeros((len(queries), len(ids)), dtype=np.float32)
    for m in range(len(books)):
        scores += tables[m][:, codes[:, m]]
    scores /= np.maximum(norms, 1e-12)
    scores[(query_ids[:, None] == ids[None, :, 0]) & (query_ids[:, None] == ids[None, :, -1])] = -np.inf
    r = min(rerank, len(ids))
    near = np.argpartition(-scores, r - 1, axis=1)[:, :r]
    products = None
    out_q, out_id, out_s = [], [], []
    for q in range(len(queries)):
        at = near[q][scores[q][near[q]] > -np.inf]
        if len(at) < len(ids):
            sure = np.sort(_cosines(vectors[at], queries[q]))[-k:]
            least = sure[0] if len(sure) == k else -np.inf
            at = np.flatnonzero((scores[q] > -np.inf) & (scores[q] + errors >= least))
            if len(at) > 2 * rerank:
                if products is None:
                    products = queries @ vectors.T
                at = at[products[q][at] >= least - 1e-12]
        exact = _cosines(vectors[at], queries[q])
        if len(at) > k:
            some = exact >= np.partition(exact, len(exact) - k)[len(exact) - k]
            at, exact = at[some], exact[some]
        each, exact = ids[at].ravel(), np.repeat(exact, ids.shape[1])
        order = np.lexsort((each, -exact))
        order = order[each[order] != query_ids[q]]
        order = order[np.sort(np.unique(each[order], return_index=True)[1])][:k]  # an id once, at its best
        out_q += [q] * len(order)
        out_id += each[order].tolist()
        out_s += exact[order].tolist()
    return out_q, out_id, out_s


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """Rows (ids, v): the distinct vectors, each with its k + 1 smallest ids in order."""
    first = Window.partitionBy("v").orderBy("vec_id")
    some = vectors.distinct().select("vec_id", "v", F.row_number().over(first).alias("at")).where(F.col("at") <= k + 1)
    return some.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "v")


def _units(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, v) with v of length 1."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column(1))) + 0.0  # one zero
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "v"])

    return vectors.mapInArrow(run, "vec_id long, v binary")


_INDEX = ["ids", "codes", "norms", "errors", "vectors"]


def _chunks(classes: DataFrame, books: np.ndarray, k: int, n: int) -> DataFrame:
    """The index of classes (chunk, ids, v), sorted by chunk: a row for each of n chunks that has any."""

    def run(batches):
        for table, start in groups_in(batches):
            for i, j in zip(start.tolist(), [*start[1:].tolist(), table.num_rows]):
                if j > i:
                    group = table.slice(i, j - i)
                    ids = np.array([x + x[-1:] * (k + 1 - len(x)) for x in group.column("ids").to_pylist()], dtype="<i8")
                    x = matrix(group.column("v"))
                    codes = encode(x, books)
                    norms = sums_norm(codes, books)
                    columns = (ids, codes, norms, error_bound(x, codes, norms, books), x)
                    yield pa.RecordBatch.from_arrays([group.column("chunk").slice(0, 1).combine_chunks(), *[pa.array([c.tobytes()], pa.binary()) for c in columns]], names=["chunk", *_INDEX])

    dealt = classes.select(F.pmod(F.xxhash64("v"), F.lit(n)).alias("chunk"), "ids", "v")
    return dealt.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk long, ids binary, codes binary, norms binary, errors binary, vectors binary")


def _blocks(queries: DataFrame) -> DataFrame:
    """Rows (block, q_ids, q_vectors) of QUERY_BLOCK queries at most."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, QUERY_BLOCK):
                some = batch.slice(a, QUERY_BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([some.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([matrix(some.column(1)).tobytes()], pa.binary())], names=["block", "q_ids", "q_vectors"])
                block += 1

    return queries.mapInArrow(run, "block long, q_ids binary, q_vectors binary")


def _met(index: DataFrame, blocks: DataFrame, n: int, n_blocks: int) -> DataFrame:
    """Every chunk, followed by every block of queries: a chunk's row goes to each of its parts once, a part has PART_BLOCKS blocks or so."""
    parts = -(-n_blocks // PART_BLOCKS)
    none = lambda names: [F.lit(None).cast("binary").alias(c) for c in names]
    chunks = index.select("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), *_INDEX, *none(["q_ids", "q_vectors"]))
    asked = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("chunk"), F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part"), *none(_INDEX), "q_ids", "q_vectors")
    return chunks.unionAll(asked).repartition("chunk", "part").sortWithinPartitions("chunk", "part", F.col("q_ids").asc_nulls_first())


def nearest(df: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """The k nearest rows of every row for which ``queries`` (a condition on vec_id) holds: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    vectors = materialise(_units(usable(df, id_col, vector_col).where("vec_id IS NOT NULL")), "ann-vectors")
    classes = materialise(_classes(vectors, k), "ann-classes")
    n_classes = classes.count()
    few = by_hash(classes.select("v"), [F.col("v")], SAMPLE, n_classes).collect()
    sample = [r["v"] for r in sorted(few, key=lambda r: (r["__order"], r["v"]))[:SAMPLE]]
    asked = vectors.where(queries)
    n_asked = asked.count()
    if not sample or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = len(sample[0]) // 8
    books = fit(np.frombuffer(b"".join(sample), dtype="<f8").reshape(-1, d))

    n = -(-n_classes // CHUNK)
    index = materialise(_chunks(classes, books, k, n), "ann-index")
    blocks = materialise(_blocks(asked.repartition(-(-n_asked // QUERY_BLOCK), F.xxhash64("vec_id", "v"))), "ann-queries")

    def run(batches):
        chunk = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["q_ids"] is None:
                    ids = np.frombuffer(row["ids"], dtype="<i8").reshape(-1, k + 1)
                    codes = np.frombuffer(row["codes"], dtype=np.uint8).reshape(len(ids), -1)
                    chunk = row["chunk"], ids, codes, np.frombuffer(row["norms"], dtype=np.float32), np.frombuffer(row["errors"], dtype="<f8"), np.frombuffer(row["vectors"], dtype="<f8").reshape(len(ids), d)
                elif chunk and chunk[0] == row["chunk"]:  # a chunk without rows has no answers
                    q_ids = np.frombuffer(row["q_ids"], dtype="<i8")
                    q, near, score = search_chunk(np.frombuffer(row["q_vectors"], dtype="<f8").reshape(len(q_ids), d), q_ids, *chunk[1:], books, k, rerank)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(near, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    found = materialise(_met(index, blocks, n, blocks.count()).mapInArrow(run, "query_id long, vec_id long, score double"), "ann-found")
    for done in (vectors, classes, index, blocks):
        discard(done)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
