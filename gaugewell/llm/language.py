"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (n = 1 to ORDERS, blended)
present in both, divided by the root of the product of the numbers present in each.
Landmarks of each language give a Nyström feature map; one-versus-rest kernel ridge
regression learns a value for each language from a bounded, documented sample of the
labelled rows (SAMPLE texts a language, of which LANDMARKS are landmarks). As the
kernel is linear in the presence vectors, landmarks, map and regression fold into one
matrix, and a block of texts is scored by one matrix product. N-grams are presence
bits in SLOTS hashed slots.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is
every text where nothing labelled can be learned from; ties go to the smaller language
name; null ids are never held out; rows that share id and text are learned from once;
only id, text and lang (for learning) are read. Every language of the labels has a sample
at the driver: their number is taken to be small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.common import bounded_batches, few_at_once, fresh, texts_of

ORDERS = 4
SLOTS = 1 << 16
SAMPLE = 150
LANDMARKS = 40
RIDGE = 1e-3
HELD_OUT_OF = 3
HELD_OUT = 1
_MIX = np.uint32(0x9E3779B1)
_LETTER = regex.compile(r"\p{L}")
#: Texts scored in one matrix product, and characters read at once.
BLOCK = 32
SEGMENT = 1 << 20


def presence(texts: list[str]) -> np.ndarray:
    """A row of 0 and 1 for each text: which hashed n-grams it has. Texts longer than SEGMENT are read in segments that share ORDERS - 1 characters."""
    if max(map(len, texts), default=0) > SEGMENT + ORDERS:
        return np.stack([_long_presence(t) for t in texts])
    out = np.zeros((len(texts), SLOTS), dtype=np.uint8)
    flat = out.reshape(-1)
    joined = "\0".join(t.lower() for t in texts)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    gap = chars == 0
    row = np.cumsum(gap, dtype=np.int64) * SLOTS
    if int(gap.sum()) != len(texts) - 1:  # a text holds the separator itself
        return np.concatenate([presence([t.replace("\0", " ")]) for t in texts])
    h = np.zeros(len(chars), dtype=np.uint32)
    bad = np.zeros(len(chars), dtype=bool)
    for n in range(ORDERS):
        if n:
            h, bad, row = h[:-1], bad[:-1], row[:-1]
        h = (h ^ chars[n:]) * _MIX
        h ^= h >> np.uint32(15)
        bad = bad | gap[n:]
        good = ~bad
        flat[row[good] + (h[good] >> np.uint32(16))] = 1
    return out


def _long_presence(text: str) -> np.ndarray:
    low, row = text.lower(), np.zeros(SLOTS, dtype=np.uint8)
    for a in range(0, max(1, len(low) - ORDERS + 1), SEGMENT):
        row |= presence([low[a : a + SEGMENT + ORDERS - 1]])[0]
    return row


def fit(bits: np.ndarray, labels: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix (SLOTS x languages) that takes a presence row over the root of its sum to the values."""
    languages = sorted(set(labels))
    y = np.array([[1.0 if l == k else -1.0 for k in languages] for l in labels])
    size = np.sqrt(np.maximum(bits.sum(axis=1, dtype=np.int64), 1)).astype(np.float64)
    seen: dict[str, int] = {}
    at = []
    for i, l in enumerate(labels):
        seen[l] = seen.get(l, 0) + 1
        if seen[l] <= LANDMARKS:
            at.append(i)
    marks = bits[at].astype(np.float32)
    # counts of shared n-grams are exact in single precision; a few rows at once bound the memory
    shared = np.concatenate([bits[a : a + BLOCK].astype(np.float32) @ marks.T for a in range(0, len(bits), BLOCK)]).astype(np.float64)
    kernel = shared / (size[:, None] * size[at])
    values, vectors = np.linalg.eigh(kernel[at])
    good = values > 1e-9 * max(values.max(initial=0), 1e-9)
    to_features = vectors[:, good] / np.sqrt(values[good])
    phi = kernel @ to_features
    # languages weigh alike, however many texts each has
    weight = np.array([1 / seen[l] for l in labels])[:, None]
    phi1 = np.hstack([phi, np.ones((len(phi), 1))])
    solve = np.linalg.solve(phi1.T @ (phi1 * weight) + RIDGE * np.eye(phi1.shape[1]), phi1.T @ (y * weight))
    of_marks = (to_features @ solve[:-1]) / size[at][:, None]
    return languages, np.vstack([marks.T @ of_marks.astype(np.float32), solve[-1:].astype(np.float32)])


def _held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Fit on SAMPLE texts of each language, by the smallest hashes of their ids and texts, none of them held out."""
    spark = df.sparkSession
    bounded_batches(spark)
    usable = F.col(lang_col).isNotNull() & ~_held_out(id_col) & F.col(text_col).isNotNull()
    # by text and id: rows without ids, or of one id, are told apart by their texts
    order = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col), F.col(text_col)), F.lit(1 << 30))
    rows = df.where(usable).select(F.col(lang_col).alias("l"), order.alias("o"), F.col(text_col).alias("t"))
    # first the share of each language's hashes that holds its sample, from their number alone
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct("o", 0.02).alias("n")).collect()}
    if not counts:
        return [], np.zeros((SLOTS + 1, 0), dtype=np.float32)
    most = [(l, int(min(1.0, 2 * (SAMPLE + 20) / n) * (1 << 30))) for l, n in counts.items()]
    limit = F.create_map(*[x for l, m in most for x in (F.lit(l), F.lit(m))])

    def bits(batches):
        for batch in batches:
            packed = [np.packbits(presence([t])[0]).tobytes() if _LETTER.search(t) else None for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["l", "o", "b"])

    # rows that repeat are one, so that what comes to the driver is bounded
    few = rows.where(F.col("o") < limit[F.col("l")]).groupBy("l", "o").agg(F.min("t").alias("t"))
    found = few.mapInArrow(bits, "l string, o long, b binary").where("b IS NOT NULL").collect()
    taken: dict[str, int] = {}
    kept = []
    for r in sorted(found, key=lambda r: (r["l"], r["o"], r["b"])):
        taken[r["l"]] = taken.get(r["l"], 0) + 1
        if taken[r["l"]] <= SAMPLE:
            kept.append(r)
    if not kept:
        return [], np.zeros((SLOTS + 1, 0), dtype=np.float32)
    return fit(np.array([np.unpackbits(np.frombuffer(r["b"], dtype=np.uint8)) for r in kept]), [r["l"] for r in kept])


def score(texts: list[str], languages: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. The score is the softmax of the one-versus-rest values."""
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    spoken = [i for i, t in enumerate(texts) if languages and _LETTER.search(t)]
    for a in range(0, len(spoken), BLOCK):
        at = spoken[a : a + BLOCK]
        x = presence([texts[i] for i in at]).astype(np.float32)
        values = (x @ matrix[:-1]) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1)) + matrix[-1]
        e = np.exp(4 * (values - values.max(axis=1, keepdims=True)).astype(np.float64))
        e /= e.sum(axis=1, keepdims=True)
        best = values.argmax(axis=1)
        for i, b, p in zip(at, best.tolist(), e[np.arange(len(at)), best]):
            names[i], scores[i] = languages[b], p
    return names, scores


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", names=("lang_pred", "score"), keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) and the prediction, from text_col alone."""
    bounded_batches(df.sparkSession)
    kept = list(df.columns if keep is None else keep)
    languages, matrix = model
    schema = df.select(*[F.col(f"`{c}`") for c in kept])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields)

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(batch.num_columns - 1))
            for a, b in few_at_once(texts, 1_000_000):
                found, p = score(texts[a:b], languages, matrix)
                columns = [c.slice(a, b - a) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(p, pa.float64())], names=[*kept, *names])

    # the text goes last under a name of its own
    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias(fresh(kept, "text"))).mapInArrow(run, f"{fields}, `{names[0]}` string, `{names[1]}` double")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score."""
    model = learn(df, id_col, text_col, lang_col)
    found = predict(df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias(text_col)), model, id_col, text_col, keep=(id_col,))
    return found.select(id_col, _held_out(id_col).alias("held_out"), "lang_pred", "score")
