"""Personal data and mixing: against plain patterns, the definition of the targets, and DuckDB."""

import hashlib
import random
import re

import duckdb
import pytest

from gaugewell.llm import mixing, pii
from gaugewell.sources.tables import table

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def fits(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def plain_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text) if fits(k, m[0]))


def random_texts():
    rnd = random.Random(8)
    parts = ["a@b.co", "x.y+z@host-1.example.org", "@", ".", "_d@e.f", "192.168.0.1", "0000001.2.3.4", "256.1.1.1", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+1 (555) 010-9999", "+44 20 7946 0958", "+1", " ", "  ", "-", "é", "日本", "9", "call ", "card ", "😀", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB82WEST12345698765433"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(300)]


TEXTS = [*random_texts(), None, "", "9" * 3000, "a" * 3000, "a@" * 500, "1.2.3.4." * 900, "a.b" * 500 + "@c.d.e", "@c" + ".d" * 4000, "x@y" + ".z" * 9000, "12 " * 9000, "+1" + "(" * 5000, "u@v.w " * 700, "1.1.1.1 " * 1200]


def found(docs):
    return pii.pii_digest(pii.detect_pii(docs)).collect()


def test_pii_against_plain_patterns(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(4)
    rows = found(docs)
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = plain_spans(TEXTS[r.doc_id] or "")
        base = ",".join(s for s in r.spans.split(",") if s and not s.startswith("iban"))
        assert base == want, TEXTS[r.doc_id][:200]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in want.split(",")) for k in PLAIN]


def test_iban_checksum_and_context(spark):
    docs = spark.createDataFrame([(1, "GB82WEST12345698765432"), (2, "GB82WEST12345698765433"), (3, "my account: GB82 WEST 1234 5698 7654 32")], "doc_id long, text string")
    rows = {r.doc_id: r for r in found(docs)}
    assert [rows[i].n_iban for i in (1, 2, 3)] == [1, 0, 1]
    assert rows[3].score_sum == pytest.approx(rows[1].score_sum + pii.CONTEXT_BOOST)


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co now, é 10.0.0.1 end"), (2, None), (3, "plain")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact_pii(docs).collect()}
    assert got == {1: "mail <EMAIL> now, é <IP> end", 2: None, 3: "plain"}


def test_pii_edge(edge, empty):
    assert len(found(edge)) == edge.count() and found(empty) == []
    assert pii.redact_pii(edge).columns == edge.columns and pii.redact_pii(edge).count() == edge.count()


def plain_targets(sizes):
    """Sharing out again and again until none is above its ceiling."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), list(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share > 2 * sizes[s]]
        if not over:
            return out | {s: weight[s] * share for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def check_mix(docs):
    rows = mixing.mix(docs).collect()
    texts = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id, r.size) for r in rows), key=str) == sorted(((r.doc_id, size(r.text)) for r in texts), key=str)
    by = {}
    for r in texts:
        by[r.source] = by.get(r.source, 0) + size(r.text)
    target = plain_targets(by)
    of = {r.doc_id: r.source for r in texts}
    taken = dict.fromkeys(by, 0)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == by[of[r.doc_id]] and r.target == pytest.approx(target[of[r.doc_id]])
        taken[of[r.doc_id]] += r.taken
    for s in by:
        assert abs(taken[s] - target[s]) <= max(6 * max(1, by[s] / mixing.LEAST_BLOCKS), 6 * mixing.BLOCK_WORDS if by[s] > mixing.BLOCK_WORDS * mixing.LEAST_BLOCKS else 0)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)


def test_mix(spark, sf):
    check_mix(table(spark, sf, "documents"))


def test_mix_of_uneven_sources(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(5000, "a"), (3, "b"), (0, "c"), (1, None), (700, "d"), (40, "e"), (41, "e")] + [(60, "f")] * 50)]
    check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_mix_edge(edge, empty):
    assert mixing.mix(edge).count() == edge.count()
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("sql,run", [(mixing.oracle(), lambda d: mixing.mix(d)), (pii.oracle(), lambda d: pii.pii_digest(pii.detect_pii(d)))])
def test_against_sql(spark, sf, sql, run):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = run(table(spark, sf, "documents"))
    rows = duck.sql(sql)
    names = rows.columns
    clean = lambda rs: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rs)
    assert clean(got.select(names).collect()) == clean(rows.fetchall())


def test_many_matches_in_linear_time(spark):
    """Time in proportion to the spans, and the context as plain slices have it."""
    import re
    import time

    took = []
    for n in (20_000, 100_000):
        text = "".join(f"mail a{i}@b.cd, ip 1.2.3.{i % 300} +49 30 123{i:06d} " for i in range(n // 2))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        row = pii.pii_digest(pii.detect_pii(docs)).first()
        took.append(time.time() - began)
        assert row.n_email == n // 2
    assert took[1] < 5 * 3 * took[0] + 10
    found = pii.detect_pii(spark.createDataFrame([(1, text[:200_000])], "doc_id long, text string")).first()
    for kind in pii.KINDS:
        for s in found[f"{kind}_spans"]:
            before = text[max(0, s.start - pii.CONTEXT_CHARS) : s.start]
            boost = pii.CONTEXT_BOOST if re.search(rf"(?i)\b(?:{pii.CONTEXT[kind]})", before) else 0
            assert s.score == round(pii.BASE_SCORE[kind] + boost, 2)
