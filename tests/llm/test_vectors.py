"""Vector operators against all pairs."""

import numpy as np
import pytest

from gaugewell.llm import ann, cap_join, queries
from gaugewell.llm.vectors import unit
from gaugewell.sources.tables import table


def frame(spark, rows, extra=True):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], "x", "y", "z") for i, v in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, w string, rep string").repartition(3)


def good(rows):
    out = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v is not None and len(v) and None not in v]
    return [(i, v) for i, v in out if np.isfinite(v).all() and np.abs(v).max() > 0]


def plain_links(rows):
    kept = good(rows)
    u = unit(np.array([v for _, v in kept]))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    links, group = {}, {i: i for i, _ in rows}
    for k, (i, _) in enumerate(kept):
        links[k] = (i, int(near[k].sum()))
        todo, seen = [k], {k}
        while todo:
            for x in np.flatnonzero(near[todo.pop()]).tolist():
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        group[i] = min(kept[x][0] for x in seen)
    counts = dict(links.values())
    return sorted((i, counts.get(i, 0), group[i], group[i] == i) for i, _ in rows)


def clustered(seed, n, d=64, spread=0.02):
    """Clusters around the threshold, copies, chains and lone vectors."""
    rnd = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        c = unit(rnd.standard_normal((1, d)))[0]
        for _ in range(int(rnd.integers(1, 6))):
            v = c + rnd.standard_normal(d) * rnd.choice([0.0, spread, 0.028, 0.04])
            rows.append(v * rnd.choice([0.5, 1, 7]))
    big = unit(rnd.standard_normal((1, d)))[0]
    rows += [big + rnd.standard_normal(d) * 0.02 for _ in range(150)] + [big] * 30
    order = rnd.permutation(len(rows))
    return [(int(i), rows[k].tolist()) for i, k in enumerate(order)]


ODD = [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] + [1.0] * 63), (1003, [None] + [1.0] * 63), (1004, []), (1005, [1.0] * 63), (1006, [float("inf")] * 64)]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_against_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(cap_join, "BLOCK", 24)
    rows = clustered(seed, 250) + ODD
    got = cap_join.embedding_links(frame(spark, rows))
    want = [r if r[0] != 1005 else (1005, 0, 1005, True) for r in plain_links([r for r in rows if r[0] != 1005] + [(1005, None)])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_links_edge(spark):
    same = [1.0] * 64
    rows = [(5, same), (5, same), (2, same), (None, same), (7, [-1.0] * 64)]
    got = sorted(map(tuple, cap_join.embedding_links(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 3, 2, False), (5, 3, 2, False), (2, 3, 2, True), (None, 3, None, True), (7, 0, 7, True)], key=str)
    assert cap_join.embedding_links(frame(spark, rows).limit(0)).count() == 0


def test_links_of_one_id_with_two_vectors(spark):
    """Each row has the links of its own vector."""
    rows = [(5, [1.0, 0, 0, 0]), (5, [0, 1.0, 0, 0]), (6, [1.0, 0.01, 0, 0]), (7, [0.01, 1.0, 0, 0]), (7, [0, 0, 1.0, 0]), (8, [0, 1.0, 0.01, 0])]
    got = sorted(map(tuple, cap_join.embedding_links(frame(spark, rows)).collect()))
    assert got == [(5, 1, 5, True), (5, 2, 5, True), (6, 1, 5, False), (7, 0, 7, True), (7, 2, 5, False), (8, 2, 5, False)]


def test_cap_code_misses_little():
    rnd = np.random.default_rng(9)
    for n in (1000, 1_000_000):
        code = cap_join.CapCode(64, n)
        x = unit(rnd.standard_normal((400, 64)))
        side = rnd.standard_normal((400, 64))
        side -= (side * x).sum(axis=1, keepdims=True) * x
        y = 0.951 * x + (1 - 0.951**2) ** 0.5 * unit(side)
        a, b = code.decode(x), code.decode(y)
        assert a.shape == (400, cap_join.ROTATIONS * cap_join.LISTED)
        assert all(set(p) & set(q) for p, q in zip(a.tolist(), b.tolist()))


def test_lists_hold_the_best_directions():
    code = cap_join.CapCode(12, 20_000)
    x = unit(np.random.default_rng(4).standard_normal((20, 12)))
    lists = code.decode(x)
    for g in range(cap_join.ROTATIONS):
        (a, b), (c, d) = code.cuts
        y = x @ code.rotations[g]
        sums = (y[:, a:b] @ code.codes[g][0].T)[:, :, None] + (y[:, c:d] @ code.codes[g][1].T)[:, None, :]
        best = np.sort(np.argsort(-sums.reshape(len(x), -1), axis=1)[:, : cap_join.LISTED], axis=1)
        assert [[i // cap_join.ROTATIONS for i in row if i % cap_join.ROTATIONS == g] for row in lists.tolist()] == best.tolist()


def plain_nearest(rows, ids, k=5):
    kept = good(rows)
    u, key = unit(np.array([v for _, v in kept])), np.array([i for i, _ in kept])
    out = {}
    for q in ids:
        at = np.flatnonzero(key == q)
        if len(at):
            s = u @ u[at[0]]
            order = [x for x in np.lexsort((key, -s)) if key[x] != q][:k]
            out[q] = [(int(key[x]), s[x]) for x in order]
    return out


def test_recall_on_a_table_of_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 700)
    docs = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, list(r.embedding)) for r in docs.collect()]
    got = ann.nearest(docs, "vec_id % 50 = 0", rerank=ann.RERANK * 700 // 8192).collect()  # the production share of a chunk
    want = plain_nearest(rows, [i for i, _ in rows if i % 50 == 0])
    assert len(got) == 5 * len(want)
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got)
    assert hits >= 0.9 * len(got)
    exact = {i: v for i, v in good(rows)}
    for r in got:
        a, b = exact[r.query_id], exact[r.vec_id]
        assert r.score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)
    for q in want:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and own == sorted(own, key=lambda r: (-r.score, r.vec_id))


@pytest.mark.parametrize("noise", [0.0, 1e-5])
def test_recall_in_a_hot_group(spark, monkeypatch, noise):
    monkeypatch.setattr(ann, "CHUNK", 700)
    rnd = np.random.default_rng(6)
    hot = unit(rnd.standard_normal((1, 64)))[0]
    rows = [(i, (hot + noise * rnd.standard_normal(64) if i % 3 == 0 else rnd.standard_normal(64)).tolist()) for i in range(3000)]
    want = plain_nearest(rows, range(0, 3000, 50))
    got = ann.nearest(frame(spark, rows), "vec_id % 50 = 0", rerank=27).collect()
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got)
    assert hits == len(got) == 5 * len(want), hits / len(got)


@pytest.mark.parametrize("rows", [900, 2500])
def test_equal_vectors_in_any_order(spark, monkeypatch, rows):
    """The smallest ids of a thousand and more equal vectors, with several chunks and parts."""
    monkeypatch.setattr(ann, "CHUNK", 300)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 8)
    monkeypatch.setattr(ann, "PART_BLOCKS", 2)
    rnd = np.random.default_rng(rows)
    table_ = [(int(i), [1.0, 2.0, 3.0] if i % 2 or i < 60 else rnd.standard_normal(3).tolist()) for i in rnd.permutation(rows)]
    got = ann.nearest(frame(spark, table_), "vec_id % 50 = 0").collect()
    want = plain_nearest(table_, range(0, rows, 50))
    for q in (0, 50):
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for i, _ in want[q]]
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got)
    assert hits == len(got) == 5 * len(want)


def test_small_table_is_exact(spark, sf):
    docs = table(spark, sf, "embeddings")
    rows = [(r.vec_id, list(r.embedding)) for r in docs.collect()]
    want = plain_nearest(rows, [i for i, _ in rows if i % 50 == 0])
    got = {}
    for r in sorted(queries.op2_nearest(spark, sf).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in v] for q, v in want.items()}


def test_nearest_edge(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (100, None), (150, [0.0, 0.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.0])]
    got = sorted(map(tuple, ann.nearest(frame(spark, rows), "vec_id % 50 = 0").select("query_id", "rank", "vec_id").collect()))
    assert got == [(0, 1, 2), (0, 2, 3), (0, 3, 50), (0, 4, 9), (50, 1, 0), (50, 2, 2), (50, 3, 3), (50, 4, 9)]
    assert ann.nearest(frame(spark, rows).limit(0), "vec_id % 50 = 0").count() == 0
    assert ann.nearest(frame(spark, rows), "vec_id = 77").count() == 0


def test_beam_search_beats_greedy():
    x = unit(np.random.default_rng(2).standard_normal((600, 16)))
    books = ann.fit(x)
    error = lambda codes: ((x - sum(books[m][codes[:, m]] for m in range(len(books)))) ** 2).sum()
    assert error(ann.encode(x, books, 8)) < error(ann.encode(x, books, 1)) < (x**2).sum()
