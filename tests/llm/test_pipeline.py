"""The pipeline's stages against plain versions of their decisions."""

from collections import Counter

import pytest
import regex

import corpus_pipeline
from gaugewell.llm import bpe, near_dups, pii
from gaugewell.llm.common import read_tokenizer
from gaugewell.sources.shared import materialise
from gaugewell.sources.tables import table

import numpy as np
from tests.llm.test_near_dups import plain_components


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = table(spark, sf, "documents"), {}
    out["start"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = materialise(stage(spark, docs, sf), name)
    return out


def test_columns_stay(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].schema == stages["start"].schema, name


def test_language_keeps_whatever_has_letters(stages):
    kept = {r.doc_id for r in stages["language_id"].collect()}
    assert kept == {r.doc_id for r in stages["start"].collect() if r.text and regex.search(r"\p{L}", r.text)}


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages["language_id"].collect()]
    assert sorted(r.doc_id for r in stages["minhash_near_dedup"].collect()) == sorted(set(plain_components(rows).values()))


def test_personal_data_is_gone(stages):
    before = {r.doc_id: r for r in stages["minhash_near_dedup"].collect()}
    after = stages["pii"].collect()
    assert sorted(before) == sorted(r.doc_id for r in after)
    found = {r.doc_id: r for r in pii.pii_digest(pii.detect_pii(stages["minhash_near_dedup"])).collect()}
    for r in after:
        if not found[r.doc_id].spans:
            assert r.text == before[r.doc_id].text
        else:
            want = before[r.doc_id].text
            spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in found[r.doc_id].spans.split(",")))
            if all(x[1] <= y[0] for x, y in zip(spans, spans[1:])):
                for a, b, k in reversed(spans):
                    want = want[:a] + f"<{k.upper()}>" + want[b:]
                assert r.text == want
        assert r.n_chars == len(r.text)
    assert not [r for r in pii.pii_digest(pii.detect_pii(stages["pii"])).collect() if r.spans]


def test_mix_repeats_whole_documents(stages):
    before = {r.doc_id: r for r in stages["pii"].collect()}
    times = Counter(r.doc_id for r in stages["mixing"].collect())
    assert set(times) <= set(before) and max(times.values()) <= 2
    assert all(r == before[r.doc_id] for r in stages["mixing"].collect())
    size = lambda t: len(regex.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(size(r.text) for r in before.values())
    assert sum(size(before[d].text) * n for d, n in times.items()) == pytest.approx(1.5 * total, rel=0.1)


def test_tokens_round_trip(stages):
    texts = {r.doc_id: r.text for r in stages["mixing"].collect()}
    codec = bpe.BpeCodec(read_tokenizer())
    rows = stages["bpe"].collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in stages["mixing"].collect())
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(read_tokenizer())
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.n_tokens and ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert codec.decode(np.array(ids, dtype=np.int64), np.array([0, len(ids)])).to_pylist() == [library.decode(ids, skip_special_tokens=False)]


def test_edge_and_empty(spark, edge, empty):
    for docs in (edge, empty):
        rows = docs
        for _, stage in corpus_pipeline.STAGES:
            rows = materialise(stage(spark, rows, ""), "edge")
        assert (rows.count() > 0) == (docs is edge)


def test_texts_of_one_id_are_documents_of_their_own(spark):
    words = [" ".join(f"{k}{i}" for i in range(60)) for k in "xyz"]
    rows = [(1, words[0]), (1, words[1]), (1, words[1] + " "), (2, words[0] + " end"), (3, words[1] + " end"), (4, words[2]), (4, words[2]), (None, words[2]), (0, words[1] + " and")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in left) == sorted([(1, words[0]), (0, words[1] + " and"), (4, words[2]), (-1, words[2])])
    assert [r.source for r in left if r.doc_id == 4] == ["s5"]


def test_null_ids_are_mixed_one_by_one(spark):
    rows = [(None if i % 2 else i, f"text {i} " + "word " * (5 + i % 40), "en", "abc"[i % 3], 9) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    times = Counter(r.text for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    size = lambda t: len(t.split())
    assert max(times.values()) <= 2
    assert sum(size(t) * n for t, n in times.items()) == pytest.approx(1.5 * sum(size(r[1]) for r in rows), rel=0.1)
