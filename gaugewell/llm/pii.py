"""Personal data: patterns propose spans, checksums confirm them, context adjusts a score.

DataFrame expressions only. A text is cut by each pattern into the pieces between
matches (``split``) and the matches (``regexp_extract_all``); running sums of their
lengths are the spans, in code points. Possessive quantifiers and look-behinds keep
the patterns linear on long runs without changing what they match.

Defined results: a null text counts as empty; an empty table gives an empty result;
repeated rows are each answered; only the named columns are read, so extra columns
don't matter; null ids are kept; a text of any length is one row's work, in time that
grows with its length and the number of its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "[A-Za-z0-9._%+-]"
_GROUP = r"(?:\.[0-9]++)"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9])[0-9]++{_GROUP}{_GROUP}{_GROUP}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
KINDS = tuple(PATTERNS)
BASE_KINDS = KINDS[:4]
#: Score of a confirmed span, and the words before it that raise the score.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer",
}
CONTEXT_CHARS = 40
CONTEXT_BOOST = 0.1
#: So many matches and what stands between them are longer than the context: no match is shorter than 4 characters.
_LED = CONTEXT_CHARS // 4
_CHUNK = 256
_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(first: Column, xs: Column) -> Column:
    """first, first + xs[0], first + xs[0] + xs[1], ...; for short arrays."""
    return F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _ends(sizes: Column) -> Column:
    """Running sums of an array (a lambda's variable) of any length, in chunks so that the copying stays linear."""
    chunks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(sizes) - 1) / _CHUNK).cast("int"))),
        lambda k: F.slice(sizes, k * _CHUNK + 1, _CHUNK),
    )

    def summed(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        return _let(
            _running(F.lit(0), totals),
            lambda offsets: F.flatten(F.transform(parts, lambda p, k: F.slice(_running(F.get(offsets, k), p), 2, _CHUNK))),
        )

    return _let(chunks, summed)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _mod97(s: Column) -> Column:
    """Remainder of the rearranged account number, letters as two digits."""
    bare = F.replace(s, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    step = lambda acc, c: F.when(
        F.ascii(c) >= 65, F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97))
    ).otherwise(F.pmod(acc * 10 + F.ascii(c) - 48, F.lit(97)))
    return F.aggregate(F.regexp_extract_all(turned, F.lit("(.)"), F.lit(1)), F.lit(0), step)


def _confirmed(kind: str, s: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        small = lambda p: F.when(F.length(part(p)) <= 3, part(p).cast("int") <= 255).otherwise(F.lit(False))
        return F.forall(F.split(s, r"\."), small)
    if kind == "card":
        return F.when(F.length(_digits(s)).between(13, 19), F.call_function("luhn_check", _digits(s))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(s, F.lit(" "), F.lit(""))).between(15, 34) & (_mod97(s) == 1)
    return F.lit(True)


def spans_of(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind: array of (kind, start, end, score), by start."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))

    def located(m: Column) -> Column:
        def placed(pieces: Column) -> Column:
            sizes = F.zip_with(pieces, m, lambda p, s: F.char_length(p) + F.char_length(s))
            # what stands before a match, from the match before it on, and no more of it than the context takes
            led = F.zip_with(F.concat(F.array(F.lit("")), F.slice(m, 1, F.size(m) - 1)), pieces, lambda s, p: F.substring(F.concat(s, p), -CONTEXT_CHARS, CONTEXT_CHARS))
            return _let(F.struct(_let(sizes, _ends).alias("ends"), led.alias("led")), confirmed)

        def confirmed(x: Column) -> Column:
            spans = F.transform(m, lambda s, i: F.struct(F.get(x["ends"], i).alias("end"), s.alias("s"), i.alias("i")))
            return F.transform(F.filter(spans, lambda y: _confirmed(kind, y["s"])), lambda y: scored(y, x["led"]))

        def scored(y: Column, led: Column) -> Column:
            some = F.least(y["i"], F.lit(_LED))
            before = F.substring(F.array_join(F.slice(led, y["i"] - some + 1, some + 1), ""), -CONTEXT_CHARS, CONTEXT_CHARS)
            near = before.rlike(rf"(?i)\b(?:{CONTEXT[kind]})")
            score = F.round(F.lit(BASE_SCORE[kind]) + F.when(near, F.lit(CONTEXT_BOOST)).otherwise(F.lit(0.0)), 2)
            return F.struct(F.lit(kind).alias("kind"), (y["end"] - F.char_length(y["s"])).alias("start"), y["end"].alias("end"), score.alias("score"))

        return _let(F.slice(F.split(text, PATTERNS[kind]), 1, F.size(m)), placed)

    return _let(found, lambda m: F.when(F.size(m) == 0, F.array().cast(_SPANS)).otherwise(located(m).cast(_SPANS)))


def detect_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds=KINDS) -> DataFrame:
    """Per row: id_col, and ``<kind>_spans`` for each kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col), *[spans_of(k, text).alias(f"{k}_spans") for k in kinds])


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digests and span lists of what detect_pii found."""
    named = lambda cols: F.array_join(
        F.transform(F.concat(*[F.col(f"{k}_spans") for k in cols]), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )
    every = F.concat(*[F.col(f"{k}_spans") for k in KINDS])
    return found.select(
        F.col(id_col),
        *[F.size(f"{k}_spans").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(named(BASE_KINDS).cast("binary"), 256).alias("base_sha256"),
        named(KINDS).alias("spans"),
        F.round(F.aggregate(F.transform(every, lambda x: x["score"]), F.lit(0.0), lambda a, x: a + x), 2).alias("score_sum"),
    )


def redact(text: Column, kind: str) -> Column:
    """text with the confirmed spans of a kind replaced by ``<KIND>``."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))

    def rebuilt(m: Column) -> Column:
        def joined(pieces: Column) -> Column:
            kept = F.zip_with(
                F.slice(pieces, 1, F.size(m)), m, lambda p, s: F.concat(p, F.when(_confirmed(kind, s), F.lit(f"<{kind.upper()}>")).otherwise(s))
            )
            return F.concat(F.array_join(kept, ""), F.element_at(pieces, -1))

        return _let(F.split(text, PATTERNS[kind]), joined)

    return _let(found, lambda m: F.when(F.size(m) == 0, text).otherwise(rebuilt(m)))


def redact_pii(df: DataFrame, text_col: str = "text", kinds=KINDS) -> DataFrame:
    """df with its texts redacted, kind after kind; null texts stay null. Row count and columns stay."""
    out = df
    for kind in kinds:
        out = out.withColumn(text_col, F.when(F.col(text_col).isNotNull(), redact(F.col(text_col), kind)))
    return out


def _sql_spans(kind: str, pattern: str, keep: str) -> str:
    """DuckDB: matches of a kind with their places."""
    return f"""
  SELECT rid, '{kind}' AS kind, {KINDS.index(kind)} AS k, (e - length(s))::BIGINT AS "start", e::BIGINT AS "end", s, text
  FROM (SELECT rid, text, s, sum(length(p) + length(s)) OVER (PARTITION BY rid ORDER BY i) AS e
        FROM (SELECT rid, text, unnest(m) AS s, unnest(string_split_regex(text, '{pattern}')[:len(m)]) AS p,
                     generate_subscripts(m, 1) AS i
              FROM (SELECT rid, text, regexp_extract_all(text, '{pattern}') AS m FROM d) WHERE len(m) > 0))
  WHERE {keep}"""


def oracle() -> str:
    """DuckDB SQL for the query's rows, from the plain patterns."""
    digits = "regexp_replace(s, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(list_reverse(string_split({digits}, '')), lambda c, i:
        CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0"""
    bare = "replace(s, ' ', '')"
    mod97 = f"""list_reduce(list_concat([0], list_transform(string_split(substring({bare}, 5) || substring({bare}, 1, 4), ''),
        lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)),
        lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END) = 1"""
    plain = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(s, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS HUGEINT), 999) > 255)) = 0"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"CASE WHEN length({digits}) BETWEEN 13 AND 19 THEN {luhn} ELSE false END"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
        "iban": (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", f"CASE WHEN length({bare}) BETWEEN 15 AND 34 THEN {mod97} ELSE false END"),
    }
    spans = "\n  UNION ALL".join(_sql_spans(k, *plain[k]) for k in KINDS)
    boosted = " ".join(
        f"WHEN '{k}' THEN {BASE_SCORE[k]} + CASE WHEN regexp_matches(substring(text, greatest(\"start\" - {CONTEXT_CHARS}, 0) + 1, \"start\" - greatest(\"start\" - {CONTEXT_CHARS}, 0)), '(?i)\\b(?:{CONTEXT[k]})') THEN {CONTEXT_BOOST} ELSE 0 END"
        for k in KINDS
    )
    label = "kind || ':' || \"start\"::BIGINT || ':' || \"end\"::BIGINT"
    counts = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({spans}),
g AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)},
       string_agg({label}, ',' ORDER BY k, "start") FILTER (k < 4) AS base, string_agg({label}, ',' ORDER BY k, "start") AS spans,
       round(sum(CASE kind {boosted} END), 2)::DOUBLE AS score_sum FROM spans GROUP BY rid)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(score_sum, 0.0)::DOUBLE AS score_sum
FROM d LEFT JOIN g USING (rid)"""
