import pytest

LONG = "the quick brown fox jumps over a lazy dog and +1 (555) 010-9999 runs. " * 6000
EDGE_TEXTS = [
    None, "", " \n\t ", "word", LONG, "same text here for two rows, again and again", "same text here for two rows, again and again",
    "9" * 30000, "a" * 30000, "a@" * 5000, "1.2.3.4." * 4000, "a.b" * 5000 + "@c.d.e", "東京 で 会う 約束 です", "\x00 nul \x1c and \x85 odd  spaces",
]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, repeats, extremes, and extra columns whose names the operators use themselves."""
    clash = ["ids", "counts", "spans", "src", "key", "chunk", "l", "o", "t", "w", "n", "taken", "block", "size", "rep", "score", "lang_pred", "__text", "id", "a", "b"]
    rows = [(i if i != 3 else None, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "s1"][i % 4], None, *([str(i)] * len(clash))) for i, t in enumerate(EDGE_TEXTS)]
    rows.append(rows[5])
    fields = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash)
    return spark.createDataFrame(rows, fields).repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
