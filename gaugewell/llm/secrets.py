"""Secret scans: known forms, and dictionary-primed zstandard novelty.

Known forms (assign, access, hex) are found by patterns over the whole text. For the
rest, strings of KEY characters that follow a sensitive word are candidates; a
candidate's novelty is what it adds to the compressed size of the code on both sides of it
(AROUND characters each), over its length. The compressor is primed with a dictionary of the identifiers that most
distinct texts share (counted over all documents; copies of a text rank as one), and the code
around the candidate comes first in its input, so names that are used elsewhere cost
little, and random strings their full length. The dictionary is bounded (IDENTIFIERS), as
every task holds it. Incompressible candidates are reported as
``novel``.

A secret must not prime its own copies: where a string is a candidate, it isn't counted
as an identifier, and other candidates that hold the same string are taken out of the
code around it. So only use outside sensitive contexts makes a string a name. A string
that runs on from the sensitive word itself (``access_token_of_the_session``) counts
with that word as one identifier.

Defined results: a null text counts as empty; rows are answered one by one, so
repeated rows, ties and null ids don't matter; an empty table gives an empty result;
only id and text are read. A text is held whole by one task, in time that grows with its
length and the number of its candidates.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.common import bounded_batches, most_frequent, texts_of
from gaugewell.sources.shared import discard, materialise

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
_HEX = re.compile("[0-9a-f]{16,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that make what follows them sensitive, and the strings that may be secrets there.
_SENSITIVE = re.compile(r"(?:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential|signature)", re.ASCII | re.IGNORECASE)
_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "signature")
LEAST_KEY = 16
_KEY = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_KEY},}}", re.ASCII)
NEAR = 48
#: Code on each side of a candidate that the compressor sees, in characters.
AROUND = 1024
NOVELTY = 0.75
#: Identifiers of the dictionary: those in most distinct texts, of IDENTIFIER's form.
IDENTIFIERS = 4096
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]{11,63}"
LEAST_DOCUMENTS = 3
_IDENTIFIER = re.compile(IDENTIFIER, re.ASCII)
_INSIDE = re.compile("[A-Za-z0-9_]", re.ASCII)
_SCANNERS: dict[str, object] = {}


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the strings of KEY characters that follow a sensitive word, in order. One pass over the text."""
    low, out = text.lower(), []
    if not any(w in low for w in _HINTS):
        return out
    runs = [m.span() for m in _KEY.finditer(text)]
    ends, done, at = [b for _, b in runs], -1, 0
    for m in _SENSITIVE.finditer(text) if runs else ():
        from_ = max(m.end(), done)
        at = bisect.bisect_left(ends, from_ + LEAST_KEY, at)  # the first run of which enough is left
        while at < len(runs) and max(runs[at][0], from_) <= m.end() + NEAR:
            start, done = max(runs[at][0], from_), ends[at]
            out.append((start, done))
            from_, at = done, at + 1
    return out


def identifiers_of(text: str) -> set[str]:
    """The identifiers of a text outside its candidates; one that runs on from a sensitive word stays whole."""
    pieces, done = [], 0
    for a, b in candidates(text):
        if a == 0 or not _INSIDE.match(text[a - 1]):
            pieces.append(text[done:a])
            done = b
    pieces.append(text[done:])
    return {w for p in pieces for w in _IDENTIFIER.findall(p)}


def shared_identifiers(df: DataFrame, text_col: str = "text") -> list[str]:
    """The identifiers in most distinct texts, of those in LEAST_DOCUMENTS rows, counted over all of them; IDENTIFIERS at most."""

    def run(batches):
        for batch in batches:
            words = [(w, h) for t, h in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()) for w in identifiers_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string()), pa.array([h for _, h in words], pa.int64())], names=["w", "h"])

    held = df.select(F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h")).mapInArrow(run, "w string, h long")
    copies = held.groupBy("w", "h").agg(F.count("*").alias("n"))
    counted = copies.groupBy("w").agg(F.count("*").alias("texts"), F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    counted = materialise(counted.select("w", "texts"), "identifiers")
    names = most_frequent(counted, "w", "texts", IDENTIFIERS)
    discard(counted)
    return names


class Scanner:
    def __init__(self, identifiers: list[str]):
        primer = "\n".join(reversed(identifiers)).encode() or b"\n" * 8  # the most frequent last: nearest
        data = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=3)
        self.zstd = zstandard.ZstdCompressor(dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)

    def novelty(self, text: str, start: int, end: int, others: list[tuple[int, int]] = ()) -> float:
        """Compressed bytes that text[start:end] adds to the code on both sides, without the other candidates that hold it, per byte."""
        candidate = text[start:end]
        held = [(a, b) for a, b in others if candidate in text[a:b] or text[a:b] in candidate]

        def side(low: int, high: int) -> str:
            pieces = []
            for a, b in held:
                if b > low and a < high:
                    pieces.append(text[low : max(a, low)])
                    low = b
            return "".join([*pieces, text[low:high]])

        around = f"{side(end, end + AROUND)}\n{side(max(0, start - AROUND), start)}".encode("utf-8", "surrogatepass")
        raw = candidate.encode()
        return (len(self.zstd.compress(around + raw)) - len(self.zstd.compress(around))) / max(1, len(raw))

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, kind's number, end) in order."""
        low = text.lower()
        out = []
        if any(w in low for w in _WORDS):
            out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        found = candidates(text)
        first = last = 0  # those that the code around a candidate may hold
        for i, (start, end) in enumerate(found):
            while found[first][1] <= start - AROUND:
                first += 1
            while last < len(found) and found[last][0] < end + AROUND:
                last += 1
            if self.novelty(text, start, end, found[first:i] + found[i + 1 : last]) >= NOVELTY:
                out.append((start, 3, end))
        return sorted(out)


def _scanner(identifiers: tuple[str, ...]) -> Scanner:
    key = hashlib.md5("\n".join(identifiers).encode()).hexdigest()
    if key not in _SCANNERS:
        _SCANNERS[key] = Scanner(list(identifiers))
    return _SCANNERS[key]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, spans (array of kind, start, end in code points, by start then kind)."""
    bounded_batches(df.sparkSession)
    identifiers = tuple(shared_identifiers(df, text_col))

    def run(batches):
        scanner = _scanner(identifiers)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scanner.spans(t)] for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[id_col, "spans"])

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` long, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digests and span lists of scan()'s rows."""
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "novel")
    return found.select(id_col, *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
