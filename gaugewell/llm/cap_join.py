"""Embedding near-duplicates by spherical-cap filters.

After a random rotation a unit vector is cut into parts; each part has a small random
code, and their product is a code of many directions. A vector is list-decoded to the
directions whose product with it exceeds its threshold, which is set so that LISTED do
(a fixed threshold leaves some vectors without any): part by part, the best partial
sums are carried on, and no others can be among the best sums. Vectors that share a
direction, of any of ROTATIONS codes, meet in its bucket and are verified by cosine in
double precision. The number of directions grows with the table, so that a bucket of
unlike vectors stays small. Of 4,000 pairs just above the threshold, none missed each
other with the codes for 10**3, 5 * 10**4, 10**6 and 10**8 rows.

Equal vectors are one class with a weight and a number of its own, whatever their ids. A bucket of any size is dealt into pairs of
blocks; a unit gives counts of links and a spanning forest, not pairs. A pair that
shares several directions is counted in the first of them.

Defined results: vectors that are null, zero, of an unusual length, or hold null or
non-finite components link with nothing; rows of equal ids and vectors count as copies,
and rows of equal ids and other vectors as other vectors, each with its own links; a null
id has a null component and is kept, and links with its copies alone; an empty table gives
an empty result; only the id and the vector are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.near_dups import groups_in
from gaugewell.llm.vectors import matrix, unit, usable
from gaugewell.plans.components import connected_components
from gaugewell.sources.shared import discard, materialise

THRESHOLD = 0.95
ROTATIONS = 6
LISTED = 6
BUCKET = 128
BLOCK = 512
MOST_PER_PART = 256


class CapCode:
    """Rotations and the parts' codes; all from a seed, the dimension and the number of rows."""

    def __init__(self, d: int, n: int, seed: int = 11):
        rnd = np.random.default_rng(seed)
        directions = max(256, n * LISTED / BUCKET)
        parts = min(2, d)
        while directions ** (1 / parts) > MOST_PER_PART and parts < d:
            parts += 1
        self.size = max(2, int(np.ceil(directions ** (1 / parts))))
        cuts = np.linspace(0, d, parts + 1).round().astype(int).tolist()
        self.cuts = list(zip(cuts, cuts[1:]))
        self.rotations = [np.linalg.qr(rnd.standard_normal((d, d)))[0] for _ in range(ROTATIONS)]
        self.codes = [[unit(rnd.standard_normal((self.size, b - a))) for a, b in self.cuts] for _ in range(ROTATIONS)]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The directions that each row of x is listed in, in order."""
        out = []
        for g, (rotation, codes) in enumerate(zip(self.rotations, self.codes)):
            y = x @ rotation
            total, direction = np.zeros((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64)
            for (a, b), code in zip(self.cuts, codes):
                scores = y[:, a:b] @ code.T
                best = _best(scores)
                total = (total[:, :, None] + np.take_along_axis(scores, best, 1)[:, None, :]).reshape(len(x), -1)
                direction = (direction[:, :, None] * self.size + best[:, None, :]).reshape(len(x), -1)
                best = _best(total)
                total, direction = np.take_along_axis(total, best, 1), np.take_along_axis(direction, best, 1)
            out.append(direction * ROTATIONS + g)
        return np.sort(np.concatenate(out, axis=1), axis=1)


def _best(scores: np.ndarray) -> np.ndarray:
    k = min(LISTED, scores.shape[1])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def _decoded(reps: DataFrame, code: CapCode) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                listed = code.decode(unit(matrix(some.column(2))))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(list(listed), pa.list_(pa.int64()))], names=["rep", "w", "v", "directions"])

    return reps.select("rep", "w", "v").mapInArrow(run, "rep long, w long, v binary, directions array<long>")


def _linked(units: DataFrame, threshold: float) -> DataFrame:
    """Of rows (unit, rep, w, v, directions, direction, block, cross): (a, null, weight linked) and (a, b, null) of a spanning forest."""

    def group(reps, w, v, listed, direction, block, cross):
        links = unit(v)
        links = links @ links.T >= threshold
        links &= (block[:, None] != block[None, :]) if cross else (block[:, None] == block[None, :])
        np.fill_diagonal(links, False)
        at = np.flatnonzero(links.any(axis=1))
        if not len(at):
            return None
        links, reps, w = links[np.ix_(at, at)], reps[at], w[at]
        earlier = [listed[i] for i in at.tolist()]
        earlier = [x[x < direction] for x in earlier]
        seen, where = np.unique(np.concatenate(earlier), return_inverse=True)
        if len(seen):
            # directions before this one that two have in common: that is where the pair was counted
            shared = np.bincount(where) > 1
            column = np.cumsum(shared) - 1
            has = np.zeros((len(at), int(shared.sum())), dtype=np.float32)
            owner = np.repeat(np.arange(len(at)), [len(x) for x in earlier])
            keep = shared[where]
            has[owner[keep], column[where[keep]]] = 1
            links &= (has @ has.T) == 0
        count = links @ w
        a, b, open_ = [], [], np.ones(len(at), dtype=bool)
        for root in range(len(at)):
            if not open_[root]:
                continue
            open_[root], front = False, [root]
            while front:
                i = front.pop()
                new = np.flatnonzero(links[i] & open_)
                open_[new] = False
                front += new.tolist()
                a += [int(reps[i])] * len(new)
                b += reps[new].tolist()
        some = count > 0
        return reps[some], count[some], a, b

    def run(batches):
        for table, start in groups_in(batches):
            ids, direction, block = (table.column(c).to_numpy() for c in ("rep", "direction", "block"))
            w, cross = table.column("w").to_numpy(), table.column("cross").to_numpy()
            v, listed = table.column("v"), table.column("directions").to_pylist()
            la, ln, ea, eb = [], [], [], []
            ends = [*start[1:].tolist(), table.num_rows] if start[-1] != table.num_rows else start[1:].tolist()
            for i, j in zip(start.tolist(), ends):
                got = group(ids[i:j], w[i:j], matrix(v.slice(i, j - i)), [np.array(x, dtype=np.int64) for x in listed[i:j]], direction[i], block[i:j], bool(cross[i])) if j - i > 1 else None
                if got:
                    la += got[0].tolist()
                    ln += got[1].tolist()
                    ea += got[2]
                    eb += got[3]
            yield pa.RecordBatch.from_arrays([pa.array(la + ea, pa.int64()), pa.array([None] * len(la) + eb, pa.int64()), pa.array(ln + [None] * len(ea), pa.int64())], names=["a", "b", "n"])

    return units.mapInArrow(run, "a long, b long, n long")


def embedding_links(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    vectors = materialise(usable(df, id_col, vector_col), "cap-vectors")
    classes = vectors.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"))
    # a class has a number of its own, as its least id may be another's too
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()), "cap-classes")
    size = vectors.select(F.count("*").alias("n"), F.max(F.octet_length("v")).alias("d")).first()
    code = CapCode((size["d"] or 8) // 8, size["n"])
    reps = materialise(_decoded(classes.where("least IS NOT NULL"), code), "cap-reps")

    members = reps.select("rep", F.explode("directions").alias("direction"))
    shared = members.groupBy("direction").agg(F.count("*").alias("n")).where("n > 1")
    members = members.join(shared.hint("merge"), "direction")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = members.select("rep", "direction", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"))
    dealt = members.select("rep", "direction", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    # of one block with itself, and of two: (i, i) and (i, j)
    unit_key = F.xxhash64("direction", F.least("block", "other"), F.greatest("block", "other"))
    crosses = dealt.select(unit_key.alias("unit"), "rep", "direction", "block", (F.col("block") != F.col("other")).alias("cross"))
    units = crosses.join(reps, "rep").select("unit", "rep", "w", "v", "directions", "direction", "block", "cross")
    found = materialise(_linked(units.repartition("unit").sortWithinPartitions("unit"), threshold), "cap-links")

    count = found.where("b IS NULL").groupBy(F.col("a").alias("c_rep")).agg(F.sum("n").alias("n"))
    group = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    linked = group.select(F.col("vertex").alias("l_rep"), "component").join(classes.select("rep", "least"), F.col("l_rep") == F.col("rep"))
    least = linked.groupBy(F.col("component").alias("c_component")).agg(F.min("least").alias("c_least"))
    linked = linked.join(least, F.col("component") == F.col("c_component")).select("l_rep", "c_least")
    known = classes.join(count, F.col("rep") == F.col("c_rep"), "left").join(linked, F.col("rep") == F.col("l_rep"), "left")
    known = known.select(F.col("v").alias("c_v"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("c_least", "least").alias("component"))
    answered = vectors.join(known, F.col("v") == F.col("c_v")).select("vec_id", "n_links", "component")
    # the others link with nothing
    own = materialise(answered, "cap-answers")
    ids = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    rest = _unusable(ids, vectors)
    for done in (vectors, classes, reps, found):
        discard(done)
    out = own.unionAll(rest)
    return out.select(
        F.col("vec_id").alias(id_col),
        F.col("n_links").cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
    )


def _unusable(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows (id, 0, null) of the vectors that usable() leaves out: by the same conditions, in SQL."""
    size = vectors.select(F.max(F.octet_length("v")).alias("d")).first()["d"] or 0
    v = F.col("vector").cast("array<double>")
    fine = (F.size("vector") == size // 8) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return ids.where(~F.coalesce(fine, F.lit(False))).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component"))


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL over all pairs."""
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT x.r AS a, y.r AS b, x.vec_id AS i, y.vec_id AS j FROM good x JOIN good y ON x.r <> y.r WHERE list_cosine_similarity(x.e, y.e) >= {threshold}),
c AS (SELECT vec_id AS i, vec_id AS j FROM v UNION SELECT c.i, l.j FROM c JOIN l ON c.j = l.i),
m AS (SELECT i, min(j) AS component_id FROM c GROUP BY i)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = v.r)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m ON m.i = v.vec_id"""
