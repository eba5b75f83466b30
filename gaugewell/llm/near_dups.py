"""Near-duplicate documents: ProbMinHash over weighted word shingles, banding, verification.

A document is the weighted set of its SHINGLE-word shingles, weighted by how often they
occur; similarity is probability Jaccard. ProbMinHash gives REGISTERS registers: every
shingle sends a Poisson process of arrivals, at its weight's rate, to random registers;
a register keeps the shingle of its first arrival, and a process ends as soon as its
next arrival is later than the latest register. Two documents agree in a register with
the probability of their similarity.

1. Copies (equal words) are one class, named by a digest of its words, whatever its ids.
2. Classes that agree in a band are compared in the band's bucket by their registers.
   A bucket of any size is dealt into pairs of blocks of BLOCK members, each a task's
   unit. Of each unit a greatest spanning forest of the estimates is proposed, not all
   pairs: as many links as members.
3. Proposed pairs are verified on the shingles themselves (>= THRESHOLD).
4. In the buckets that still join different components, all pairs across components
   whose estimate is within MARGIN of the threshold are verified too, inside the bucket's
   units: their members, not the pairs, are dealt out with their shingles, a pair is
   verified in the first band that it shares, and pairs that earlier ones have joined are
   passed over. No candidate that could join two components is left out.
5. Components of the verified links are the groups.

Words are runs of characters other than ASCII white space, in lower case. Defined
results: a text without words (or null) is like no other; a text of fewer words than a
shingle is one shingle; rows that share an id are each answered by their text; rows with
a null id take no part and are kept; an empty table gives an empty result; only id and
text are read. A text is held whole by one task, at some 100 bytes a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.common import bounded_batches, few_at_once, texts_of
from gaugewell.plans.components import connected_components
from gaugewell.plans.bitmap import maybe_among
from gaugewell.sources.shared import discard, materialise

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS = 256
BANDS, BAND_ROWS = 25, 5
#: Four standard deviations of an estimate at the threshold.
MARGIN = 0.1
BLOCK = 512

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_SEGMENT = 1 << 20
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables():
    """Powers of an odd number modulo 2**64, of its inverse, and a value for each byte."""
    if not _POWERS:
        base = 0xD1342543DE82EF95
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(_SEGMENT + 1, dtype=np.uint64)
            p[1:] = _U(b)
            _POWERS.append(np.multiply.accumulate(p))
        _POWERS.append(_mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN))
    return _POWERS


def word_hashes(data: bytes, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every word of UTF-8 text. Longer text is cut where a word ends. marks: of each byte, whether it is cut off at the ends of words."""
    up, down, values = _tables()
    all_bytes = np.frombuffer(data, dtype=np.uint8)
    hashes, places, start = [], [], 0
    while start < len(all_bytes):
        raw = all_bytes[start : start + _SEGMENT]
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        if start + len(raw) < len(all_bytes):
            at = np.flatnonzero(space)
            if len(at):
                raw, space = raw[: at[-1] + 1], space[: at[-1] + 1]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
        first, end = edge[::2], edge[1::2]
        if marks is not None:
            inner, at = ~marks[raw], np.arange(len(raw))
            first = np.minimum.accumulate(np.where(inner, at, len(raw))[::-1])[::-1][first]
            end = np.maximum.accumulate(np.where(inner, at, -1))[end - 1] + 1
            first, end = first[first < end], end[first < end]
        sums = np.concatenate(([_U(0)], np.cumsum(values[raw] * up[: len(raw)], dtype=np.uint64)))
        hashes.append(_mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64)))
        places.append(first + start)
        start += len(raw)
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts, one after another, and where each text's begin (one more entry than texts)."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
    hashes, places = word_hashes(b"\n".join(raw))
    return hashes, np.searchsorted(places, offsets)


def shingles_of(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, hash, weight; by text, then hash."""
    n = np.diff(starts)
    count = np.where(n == 0, 0, np.maximum(n - SHINGLE + 1, 1))
    text = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + starts[:-1][text]
    h = np.zeros(len(text), dtype=np.uint64)
    for k in range(SHINGLE):
        inside = at + k < starts[1:][text]
        h = h * _U(0xD1342543DE82EF95) + np.where(inside, words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else _U(0), _U(k + 1))
    h = _mix(h)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], h[first], np.diff(np.append(first, len(h))).astype(np.float64)


def prob_minhash(text: np.ndarray, h: np.ndarray, w: np.ndarray, n_texts: int) -> np.ndarray:
    """Registers (n_texts x REGISTERS) of weighted sets: the hash of the element that arrives first, 0 if there is none."""
    time = np.full(n_texts * REGISTERS, np.inf)
    first = np.zeros(n_texts * REGISTERS, dtype=np.uint64)
    latest = np.full(n_texts, np.inf)
    arrival = np.zeros(len(h))
    turn = 0
    while len(h):
        turn += 1
        r = _mix(h + _U(turn * int(_GOLDEN) & (1 << 64) - 1))
        arrival = arrival - np.log(((r >> _U(11)).astype(np.float64) + 1) * 2.0**-53) / w
        early = arrival < latest[text]
        text, h, w, arrival, r = text[early], h[early], w[early], arrival[early], r[early]
        slot = text * REGISTERS + (_mix(r + _GOLDEN) % _U(REGISTERS)).astype(np.int64)
        np.minimum.at(time, slot, arrival)
        won = time[slot] == arrival
        first[slot[won]] = h[won]
        open_ = text[np.flatnonzero(np.diff(text, prepend=-1))]
        latest[open_] = time.reshape(n_texts, REGISTERS)[open_].max(axis=1)
        early = arrival < latest[text]
        text, h, w, arrival = text[early], h[early], w[early], arrival[early]
    return first.reshape(n_texts, REGISTERS)


def probability_jaccard(h1, w1, h2, w2) -> float:
    """Sum over shared elements i of 1 / sum_j max(x_j / x_i, y_j / y_i); the hashes are sorted."""
    at = np.searchsorted(h2, h1)
    shared = (at < len(h2)) & (h2[np.minimum(at, len(h2) - 1)] == h1)
    if not shared.any():
        return 0.0
    x, y = w1[shared], w2[at[shared]]
    only_x, only_y = w1.sum() - x.sum(), w2.sum() - y.sum()
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    ratio = y / x
    # in this order, for element i: up to i (and its equals) x_j / x_i is the greater, after it y_j / y_i
    upto = np.searchsorted(ratio, ratio, side="right")
    px, py = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(y)))
    return float((1.0 / ((px[upto] + only_x) / x + (py[-1] - py[upto] + only_y) / y)).sum())


def _keys(words: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Names of the texts' classes."""
    return [hashlib.md5(words[i:j].tobytes()).digest() for i, j in zip(starts[:-1].tolist(), starts[1:].tolist())]


def sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, mark, key, registers, bands); the last three are null for a text without words. mark: a hash of the text."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in few_at_once(texts, 1_000_000):
                words, starts = words_of(texts[a:b])
                registers = prob_minhash(*shingles_of(words, starts), b - a)
                rows = registers[:, : BANDS * BAND_ROWS].reshape(b - a, BANDS, BAND_ROWS)
                bands = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN, (b - a, 1))
                for k in range(BAND_ROWS):
                    bands = _mix(bands ^ rows[:, :, k]) + _U(k)
                short = (registers & _U(0xFFFF)).astype("<u2")
                some = (np.diff(starts) > 0).tolist()
                keys = _keys(words, starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array([k if s else None for k, s in zip(keys, some)], pa.binary()),
                        pa.array([r.tobytes() if s else None for r, s in zip(short, some)], pa.binary()),
                        pa.array([x if s else None for x, s in zip(bands.view(np.int64).tolist(), some)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "mark", "key", "registers", "bands"],
                )

    return df.select(F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(F.col(text_col))).mapInArrow(run, "doc_id long, mark long, key binary, registers binary, bands array<long>")


def weighted_sets(df: DataFrame) -> DataFrame:
    """Rows (key, h, w) of the column text: its class's key, shingle hashes in order, and weights."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in few_at_once(texts, 1_000_000):
                words, starts = words_of(texts[a:b])
                text, h, w = shingles_of(words, starts)
                cut = np.searchsorted(text, np.arange(b - a + 1)).tolist()
                hs = [h[i:j].tobytes() for i, j in zip(cut, cut[1:])]
                ws = [None if (w[i:j] == 1).all() else w[i:j].astype("<u4").tobytes() for i, j in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(_keys(words, starts), pa.binary()), pa.array(hs, pa.binary()), pa.array(ws, pa.binary())], names=["key", "h", "w"])

    return df.select("text").mapInArrow(run, "key binary, h binary, w binary")


def groups_in(batches):
    """Arrow tables of whole groups (runs of equal values in column 0), and where the groups begin."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now])
        key = now.column(0).to_numpy()
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        held = now.slice(int(start[-1]))
        if len(start) > 1:
            yield now.slice(0, int(start[-1])), start
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _estimates(registers: np.ndarray) -> np.ndarray:
    """Shares of equal registers, all against all."""
    n = len(registers)
    out = np.empty((n, n))
    for i in range(n):
        out[i] = (registers == registers[i]).mean(axis=1)
    return out


def _forest(similar: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Greatest spanning forest of the pairs that reach least."""
    n = len(similar)
    best, to, inside, out = np.full(n, -1.0), np.zeros(n, dtype=int), np.zeros(n, dtype=bool), []
    for _ in range(n):
        i = int(np.where(inside, -2.0, best).argmax())
        if best[i] >= least:
            out.append((to[i], i))
        inside[i] = True
        closer = similar[i] > best
        best[closer], to[closer] = similar[i][closer], i
    return out


def _proposals(units: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, worth verifying: a forest of each unit of _units()."""
    least = THRESHOLD - MARGIN

    def run(batches):
        for table, start in groups_in(batches):
            reps, registers = table.column("rep").to_numpy(), _registers(table)
            a, b = [], []
            size = np.diff(start)
            two = start[:-1][size == 2]
            if len(two):  # most buckets: all at once
                two = two[(registers[two] == registers[two + 1]).mean(axis=1) >= least]
                a += reps[two].tolist()
                b += reps[two + 1].tolist()
            for i, n in zip(start[:-1][size > 2].tolist(), size[size > 2].tolist()):
                pairs = _forest(_estimates(registers[i : i + n]), least)
                a += [int(reps[i + x]) for x, _ in pairs]
                b += [int(reps[i + y]) for _, y in pairs]
            a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
            some = a != b
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[some]), pa.array(np.maximum(a, b)[some])], names=["a", "b"])

    return units.mapInArrow(run, "a long, b long").distinct()


def _registers(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("registers").to_pylist()), dtype="<u2").reshape(-1, REGISTERS)


def _units(members: DataFrame, reps: DataFrame) -> DataFrame:
    """Members (band, rep, n, component) of buckets of n, dealt into pairs of blocks and sorted by unit."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.select("*", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"))
    dealt = dealt.select("band", "rep", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    unit = F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other"))
    dealt = dealt.select(unit.alias("unit"), "band", "rep", "component").join(reps.select("rep", "registers", "bands"), "rep")
    return dealt.select(*_UNIT).repartition("unit").sortWithinPartitions("unit")


_UNIT = ["unit", "band", "rep", "component", "registers", "bands"]
_UNIT_TYPES = "unit long, band long, rep long, component long, registers binary, bands array<long>"


def _open_pairs(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a unit's pairs across components whose estimate may reach the threshold, the likeliest first; each pair in the first band that it shares only."""
    component, band = group.column("component").to_numpy(), group.column("band")[0].as_py()
    if (component == component[0]).all():
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    similar = _estimates(_registers(group))
    x, y = np.nonzero(np.triu((similar >= THRESHOLD - MARGIN) & (component[:, None] != component[None, :]), 1))
    bands = np.array(group.column("bands").to_pylist(), dtype=np.int64)
    first = np.concatenate([np.zeros(0, dtype=bool), *[bands[x[k : k + 65536], (bands[x[k : k + 65536]] == bands[y[k : k + 65536]]).argmax(axis=1)] == band for k in range(0, len(x), 65536)]]).astype(bool)
    x, y = x[first], y[first]
    order = np.argsort(-similar[x, y], kind="stable")
    return x[order], y[order]


def _groups(batches):
    for table, start in groups_in(batches):
        for i, j in zip(start.tolist(), [*start[1:].tolist(), table.num_rows]):
            if j - i > 1:
                yield table.slice(i, j - i)


def _open_members(units: DataFrame) -> DataFrame:
    """The rows of _units() that have an open pair there."""

    def run(batches):
        for group in _groups(batches):
            x, y = _open_pairs(group)
            if len(x):
                yield from group.take(np.unique(np.concatenate([x, y]))).combine_chunks().to_batches()

    return units.mapInArrow(run, _UNIT_TYPES)


def _links_inside(units: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of a unit; rows of _open_members() with h and w, sorted by unit."""

    def run(batches):
        for group in _groups(batches):
            x, y = _open_pairs(group)
            reps, component = group.column("rep").to_numpy(), group.column("component").to_pylist()
            parent = {c: c for c in component}

            def root(c):
                while parent[c] != c:
                    parent[c] = parent[parent[c]]
                    c = parent[c]
                return c

            sets = [_weighted(h, w) for h, w in zip(group.column("h").to_pylist(), group.column("w").to_pylist())]
            a, b = [], []
            for i, j in zip(x.tolist(), y.tolist()):
                p, q = root(component[i]), root(component[j])
                if p != q and probability_jaccard(*sets[i], *sets[j]) >= THRESHOLD - 1e-12:
                    parent[p] = q
                    a.append(min(reps[i], reps[j]))
                    b.append(max(reps[i], reps[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return units.mapInArrow(run, "a long, b long").distinct()


def _weighted(h: bytes, w: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of a row of weighted_sets()."""
    h = np.frombuffer(h, dtype=np.uint64)
    return h, np.ones(len(h)) if w is None else np.frombuffer(w, dtype="<u4").astype(np.float64)


def _sets_of(wanted: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, h, w) of the classes that wanted (rep) names. texts: (doc_id, text).

    A bitmap of bounded size over their least ids goes to every scan task; only texts that
    it lets through are cut into shingles, and those of other classes go at the exact join
    that follows, at every size of either side.
    """
    named = materialise(classes.select("rep", "key", "doc_id").join(wanted.distinct().hint("merge"), "rep", "left_semi"), "near-wanted")
    maybe = maybe_among(texts, "doc_id", named, "doc_id")
    sets = weighted_sets(maybe).groupBy("key").agg(F.first("h").alias("h"), F.first("w").alias("w"))
    found = materialise(sets.join(named.select("key", "rep").hint("merge"), "key").select("rep", "h", "w"), "near-sets")
    discard(named)
    return found


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose similarity reaches THRESHOLD."""
    left = sets.select(F.col("rep").alias("a"), F.col("h").alias("h1"), F.col("w").alias("w1"))
    right = sets.select(F.col("rep").alias("b"), F.col("h").alias("h2"), F.col("w").alias("w2"))

    def run(batches):
        for batch in batches:
            h1, w1, h2, w2 = (batch.column(c).to_pylist() for c in ("h1", "w1", "h2", "w2"))
            keep = [probability_jaccard(*_weighted(a, b), *_weighted(c, d)) >= THRESHOLD - 1e-12 for a, b, c, d in zip(h1, w1, h2, w2)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return joined.select("a", "b", "h1", "w1", "h2", "w2").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: bool = False) -> DataFrame:
    """Per row: id, class_id (least id of its copies), component_id (least id of its group), kept (is it that one).

    Where two texts of a group share its least id, the rows of one are kept. names adds mark
    (xxhash64 of the text) and key (of its words), which tell rows of one id apart.
    """
    bounded_batches(df.sparkSession)
    docs = materialise(sketches(df, id_col, text_col), "near-sketches")
    # equal words have equal registers, so any row's will do; copies are folded before they are sent
    reps = docs.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("registers").alias("registers"), F.first("bands").alias("bands"))
    # a class has a number of its own, as its least id may be another's too
    reps = materialise(reps.where("doc_id IS NOT NULL").withColumn("rep", F.monotonically_increasing_id()), "near-reps")
    classes = reps.select("rep", "key", "doc_id")
    members = reps.select("rep", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(members.join(shared.hint("merge"), "band").select("band", "rep", "n"), "near-members")
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    first = materialise(_proposals(_units(members.withColumn("component", F.col("rep")), reps)), "near-first")
    sets = _sets_of(first.select(F.col("a").alias("rep")).unionAll(first.select("b")), classes, texts)
    links = materialise(_verified(first, sets), "near-links")
    found = connected_components(links)
    for done in (first, sets, links):
        discard(done)
    # buckets of two are settled; of the others, those that join components that differ
    grouped = members.where("n > 2").join(found.withColumnRenamed("vertex", "rep").hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    grouped = materialise(grouped.select("band", "rep", "n", "component"), "near-grouped")
    unsettled = grouped.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("band")
    open_ = materialise(_open_members(_units(grouped.join(unsettled.hint("merge"), "band"), reps)), "near-open")
    sets = _sets_of(open_.select("rep"), classes, texts)
    more = materialise(_links_inside(open_.join(sets.hint("merge"), "rep").select(*_UNIT, "h", "w").repartition("unit").sortWithinPartitions("unit")), "near-more")
    # what the first links joined stands as links to the least vertex of each component
    found = connected_components(found.select(F.col("vertex").alias("a"), F.col("component").alias("b")).unionAll(more))
    for done in (members, grouped, open_, sets, more):
        discard(done)

    linked = found.select(F.col("vertex").alias("rep"), "component").join(classes.select("rep", F.struct(F.col("doc_id").alias("id"), "key").alias("least")).hint("merge"), "rep")
    least = linked.groupBy("component").agg(F.min("least").alias("least"))
    linked = linked.select("rep", "component").join(least.hint("merge"), "component").select("rep", "least")
    own = F.struct(F.col("doc_id").alias("id"), "key")
    group = classes.join(linked.hint("merge"), "rep", "left").select(F.col("key").alias("k"), F.col("doc_id").alias("class_id"), F.coalesce("least", own).alias("least"))
    group = group.select("k", "class_id", F.col("least.id").alias("component_id"), (F.col("least.key") == F.col("k")).alias("first"))
    named = docs.where("key IS NOT NULL").join(group.hint("merge"), F.col("key") == F.col("k"), "left").select("doc_id", "mark", "key", "class_id", "component_id", "first")
    wordless = docs.where("key IS NULL").select("doc_id", "mark", "key", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    known = F.col("doc_id").isNotNull()
    return named.unionAll(wordless).select(
        F.col("doc_id").alias(id_col),
        F.when(known, F.col("class_id")).alias("class_id"),
        F.when(known, F.col("component_id")).alias("component_id"),
        F.coalesce((F.col("doc_id") == F.col("component_id")) & F.col("first"), F.lit(True)).alias("kept"),
        *(["mark", "key"] if names else []),
    )
