"""What the operators share: batch sizes, tokenizer files, values of chunks of text."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: bounds what a Python worker holds at once.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the bounds of this session's Arrow batches to BATCH_ROWS and BATCH_BYTES; lower ones stay. They hold for lazy results too, so they aren't taken back. A single text may still be larger than a batch."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = re.match(r"-?\d+", spark.conf.get(key))
        if not now or not 0 < int(now[0]) <= most or not spark.conf.get(key).rstrip("b").isdigit():
            spark.conf.set(key, str(most))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def read_tokenizer(path: str | None = None) -> str:
    """The JSON of a tokenizer, without truncation and padding. Read on the driver and sent with the code."""
    with open(path or default_tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["truncation"] = spec["padding"] = None
    return json.dumps(spec, ensure_ascii=False)


def drops_space(spec: dict) -> bool:
    """Whether white space only separates: then a text's ids are those of its chunks, one after another."""
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", " ")
    inside = re.sub(r"\[\^\\s", "", pattern)
    norm = spec.get("normalizer") or {}
    known = all(
        n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n.get("pattern") == {"Regex": "\\s+"} and n.get("content") == " ")
        for n in norm.get("normalizers", [norm] if norm else [])
    )
    return known and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and "\\s" not in inside and " " not in inside


def lowers(spec: dict) -> bool:
    norm = spec.get("normalizer") or {}
    return any(n.get("type") == "Lowercase" for n in norm.get("normalizers", [norm]))


def strings(column: pa.Array) -> list[str]:
    """Strings of a column without nulls, some ten times as fast as to_pylist()."""
    return column.to_numpy(zero_copy_only=False).tolist()


class ChunkValues:
    """Values of texts' chunks (what ASCII white space separates), computed once per chunk.

    value(chunks, known) gives the values of distinct chunks that aren't known. The
    memory is bounded: it is emptied when it holds ``most`` chunks. Texts of Latin
    letters are put in lower case first where the tokenizer does so; others, whose lower
    case may depend on context, and those that spell a special token keep their chunks.
    """

    _OTHER = re.compile("[\u0250-\U0010ffff]")

    def __init__(self, value, lower: bool, specials: list[str], most: int):
        self.value, self.lower, self.most = value, lower, most
        self.specials = [s.lower() for s in specials]
        self.known: dict[str, object] = {}

    def _plain(self, text: str) -> str:
        if not self.lower or (not text.isascii() and self._OTHER.search(text)):
            return text
        low = text.lower()
        return text if any(s in low for s in self.specials) else low

    def split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct chunks, the number of each chunk among them, and where each text's chunks begin (one more entry than texts)."""
        split = pc.ascii_split_whitespace(pa.array([self._plain(t) for t in texts], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)

    def __call__(self, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray]:
        """Values of the distinct chunks, the number of each chunk's value, and where each text's chunks begin (one more entry than texts)."""
        if len(self.known) > self.most:
            self.known = {}
        chunks, which, starts = self.split(texts)
        chunks = strings(chunks)
        new = [c for c in chunks if c not in self.known]
        if new:
            self.known.update(zip(new, self.value(new, self.known)))
        return list(map(self.known.__getitem__, chunks)), which, starts


def few_at_once(texts: list[str], most_chars: int = 4_000_000):
    """Slices of a batch whose texts have so many characters together, or one text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most_chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of a column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def fresh(columns: list[str], name: str) -> str:
    """A column name that isn't among columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_hash(df: DataFrame, hashed: list, most: int, n: int | None = None) -> DataFrame:
    """Of n rows (counted, if None) some 2 * most by the smallest hashes, all if there are no more: what may come to the driver, however many rows and partitions there are. The column __order has the hash."""
    n = df.count() if n is None else n
    limit = int(min(1.0, 2 * (most + 64) / max(n, 1)) * (1 << 40))
    return df.withColumn("__order", F.pmod(F.xxhash64(*hashed), F.lit(1 << 40))).where(F.col("__order") < limit)


def most_frequent(df: DataFrame, key: str, n: str, most: int) -> list[str]:
    """The keys with the highest n, which are over 0: up to ``most``, the highest first. Those that tie at the cut, to a sixty-fourth of an octave, are taken by their hashes."""
    level = F.floor(F.log2(F.col(n)) * 64)
    levels = sorted(((r["l"], r["c"]) for r in df.groupBy(level.alias("l")).agg(F.count("*").alias("c")).collect()), reverse=True)
    taken, some, whole = 0, [], df
    for at, c in levels:
        if taken + c > most:
            whole = df.where(level > at)
            some = by_hash(df.where(level == at), [F.col(key)], most - taken, c).collect()
            break
        taken += c
    some = sorted(some, key=lambda r: (r["__order"], r[key]))[: most - taken]
    return [r[key] for r in sorted([*some, *whole.collect()], key=lambda r: (-r[n], r[key]))]
