"""Cross-entropy difference against plain bigram models counted in Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugewell.llm import lm_score, queries
from gaugewell.sources.tables import table


def tokens(text):
    words = [w.strip(lm_score.MARKS) for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower())]
    return [w for w in words if w]


def plain(rows, target, sample):
    """{position: (tokens, losses in the three models)}; rows: (id, text); target, sample: positions."""
    words = [tokens(t) for _, t in rows]
    size = max(1, len({w for ws in words for w in ws}))
    counted = lambda ws: (Counter(ws), Counter(zip(["", *ws], ws)), len(ws), int(bool(ws)))
    out = {}
    parts = [target, sample, set(range(len(rows)))]
    models = []
    for part in parts:
        uni, pairs, n, some = Counter(), Counter(), 0, 0
        for i in part:
            u, p, k, s = counted(words[i])
            uni, pairs, n, some = uni + u, pairs + p, n + k, some + s
        models.append((uni, pairs, n, some))
    for i, ws in enumerate(words):
        own, losses = counted(ws), []
        for part, (uni, pairs, n, some) in zip(parts, models):
            u, p, k, s = own if i in part else (Counter(), Counter(), 0, 0)
            loss = 0.0
            for c, w in zip(["", *ws], ws):
                p1 = (uni[w] - u[w] + lm_score.ADDED) / (n - k + lm_score.ADDED * size)
                before = uni[c] - u[c] if c else some - s
                loss -= math.log((pairs[c, w] - p[c, w] + lm_score.PRIOR * p1) / (before + lm_score.PRIOR))
            losses.append(loss / max(1, len(ws)))
        out[i] = (len(ws), *losses)
    return out


def sampled(rows, docs, target):
    """Positions of the fewest documents, in the order of their hashes, that have the target's tokens."""
    order = {(r.doc_id, r.text): r.u for r in docs.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2).alias("u")).collect()}
    left, out = sum(len(tokens(rows[i][1])) for i in target), set()
    for i in sorted(range(len(rows)), key=lambda i: order[rows[i]]):
        if left > 0:
            out.add(i)
            left -= len(tokens(rows[i][1]))
    return out


def compared(docs, got, target_ids):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    target = {i for i, (d, _) in enumerate(rows) if d in target_ids}
    want = plain(rows, target, sampled(rows, docs, target))
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, (d, _) in enumerate(rows):
        n, t, b, c = want[i]
        assert by[d].n_tokens == n
        if n:
            assert (by[d].target_loss, by[d].background_loss, by[d].corpus_loss, by[d].score) == pytest.approx((t, b, c, t - b), abs=1e-9)
        else:
            assert by[d].target_loss is None and by[d].score is None and by[d].corpus_loss is None


@pytest.mark.parametrize("chunk", [5_000_000, 40])
def test_against_plain_models(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm_score, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(lm_score, "RANGE_TOKENS", chunk)
    rows = [(i, t) for i, t in enumerate(["the cat sat on the mat. " * 3, "a dog sat, on a log", "the end", "cat cat cat", "", None, "zebra!", "... ,", "The (end) of \x1f the mat", "the end"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(0,), (0,), (6,), (4,), (None,)], "doc_id long")
    compared(docs, lm_score.score(docs, target).collect(), {0, 4, 6})


def test_documents(spark, sf):
    docs = table(spark, sf, "documents")
    good = {r.doc_id for r in table(spark, sf, "labels").where("quality = 1").collect()}
    compared(docs, queries.op8_lm_score(spark, sf).collect(), good)


def test_one_distribution_scores_zero(spark):
    """A small target from the corpus's own distribution: neither model gains by its size, nor a target document by being in it."""
    rnd = random.Random(4)
    words = [f"w{int(rnd.paretovariate(0.7)) % 4000}" for _ in range(300_000)]
    rows = [(i, " ".join(words[100 * i : 100 * i + 100])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = lm_score.score(docs, docs.where("doc_id % 50 = 7").select("doc_id")).collect()
    inside = [r.score for r in got if r.doc_id % 50 == 7]
    outside = [r.score for r in got if r.doc_id % 50 != 7]
    assert abs(sum(outside) / len(outside)) < 0.05 and abs(sum(inside) / len(inside)) < 0.1


def test_target_documents_score_lower(spark):
    docs = spark.createDataFrame([(i, "red green blue " * 5 if i % 2 else "one two three " * 5) for i in range(40)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.score(docs, docs.where("doc_id % 4 = 1").select("doc_id")).collect()}
    assert max(s for i, s in got.items() if i % 2) < min(s for i, s in got.items() if not i % 2)


def test_pairs_of_rare_words_count(spark):
    """Same words, rare ones in another order: only the pairs differ."""
    fill = " ".join(f"common{i}" for i in range(600))
    rows = [(i, f"{fill} {fill} " + ("raree rareu" if i % 2 else "rareu raree")) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.score(docs, docs.where("doc_id % 2 = 1").select("doc_id")).collect()}
    assert max(s for i, s in got.items() if i % 2) < min(s for i, s in got.items() if not i % 2) - 1e-6


def test_copies_stand_out_in_the_corpus(spark):
    rnd = random.Random(6)
    texts = [" ".join(f"v{rnd.randrange(3000)}" for _ in range(80)) for _ in range(300)]
    rows = list(enumerate(texts + texts[:10]))
    got = {r.doc_id: r.corpus_loss for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(5,)], "doc_id long")).collect()}
    twice = [got[i] for i in range(10)]
    assert max(twice) < min(got[i] for i in range(10, 300))


def test_edge(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long")
    got = lm_score.score(edge, none).collect()
    assert len(got) == edge.count() and all(r.score in (0, None) for r in got)
    named = edge.where("doc_id IS NOT NULL")
    all_ = lm_score.score(named, named.select("doc_id")).collect()
    assert all(r.score is None or abs(r.score) < 1e-9 for r in all_)
    assert lm_score.score(empty, none).count() == 0
