"""Near duplicates against all pairs compared by the definition."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from gaugewell.llm import near_dups
from gaugewell.sources.tables import table


def shingles(text):
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(x, y):
    """Probability Jaccard, term by term."""
    every = set(x) | set(y)
    total = Fraction(0)
    for i in set(x) & set(y):
        total += 1 / sum(max(Fraction(x[j], x[i]), Fraction(y[j], y[i])) for j in every)
    return total


def plain_components(rows):
    """{doc_id: least id of its group} by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    by = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            by[g].append(d)
    pairs = {(a, b) for ds in by.values() for a in ds for b in ds if a < b}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in pairs:
        x, y = sets[a], sets[b]
        if max(x.values()) == max(y.values()) == 1:
            close = len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y)) - 1e-9
        else:
            close = len(set(x) & set(y)) >= 0.4 * min(len(x), len(y)) and similarity(x, y) >= Fraction(8, 10)
        if close and root(a) != root(b):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {d: root(d) for d in sets}


def found(df):
    rows = near_dups.near_duplicates(df).collect()
    for r in rows:
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    return {r.doc_id: r.component_id for r in rows}


def test_against_all_pairs(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == plain_components(rows)


def planted(seed=3, n=150):
    """A base text, copies with edits of many sizes, exact copies, and texts of their own."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    base = [rnd.choice(words) for _ in range(120)]
    texts = []
    for i in range(n):
        t = list(base)
        for _ in range(rnd.randint(0, 5)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        texts.append(" ".join(t))
    texts += [" ".join(base)] * 40
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 80))) for _ in range(100)]
    texts += ["Line of words that is said again and again\n" * k for k in (3, 30, 33, 300)]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(docs) == plain_components(rows)


def test_edge(edge, empty):
    rows = near_dups.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: r for r in rows}
    assert by[5].component_id == by[6].component_id == 5 and by[6].class_id == 5 and not by[6].kept
    assert by[0].kept and by[1].kept and by[2].kept and by[None].kept and by[None].component_id is None
    assert near_dups.near_duplicates(empty).count() == 0


def test_probability_jaccard():
    rnd = random.Random(1)
    for _ in range(50):
        x = Counter({i: rnd.randint(1, 4) for i in rnd.sample(range(20), rnd.randint(1, 12))})
        y = Counter({i: rnd.randint(1, 4) for i in rnd.sample(range(20), rnd.randint(1, 12))})
        arrays = [(np.array(sorted(s), dtype=np.uint64), np.array([float(s[k]) for k in sorted(s)])) for s in (x, y)]
        assert near_dups.probability_jaccard(*arrays[0], *arrays[1]) == pytest.approx(float(similarity(x, y)), abs=1e-12)


def test_registers_estimate_probability_jaccard():
    rnd = np.random.default_rng(5)
    h = rnd.integers(1, 2**63, 900).astype(np.uint64)
    w1, w2 = rnd.integers(1, 5, 600).astype(float), rnd.integers(1, 5, 600).astype(float)
    x, y = np.sort(h[:600]), np.sort(h[100:700])
    want = near_dups.probability_jaccard(x, w1, y, w2)
    got = near_dups.prob_minhash(np.repeat([0, 1], 600), np.concatenate([x, y]), np.concatenate([w1, w2]), 2)
    assert abs((got[0] == got[1]).mean() - want) < 4 * (want * (1 - want) / near_dups.REGISTERS) ** 0.5


def test_words_across_segments(monkeypatch):
    text = ("alpha beta\tgamma\n" * 50 + "x" * 300 + " end").encode()
    whole = near_dups.word_hashes(text)
    monkeypatch.setattr(near_dups, "_SEGMENT", 400)
    cut = near_dups.word_hashes(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_one_id_with_two_texts(spark):
    """The links of both texts of an id count."""
    rnd = random.Random(8)
    texts = [" ".join(f"{k}{rnd.randint(0, 10**6)}" for _ in range(60)) for k in "xyz"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0] + " end"), (3, texts[1] + " end"), (4, texts[2]), (4, texts[2]), (None, texts[2])]
    for order in (rows, rows[::-1]):
        got = near_dups.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True)]
