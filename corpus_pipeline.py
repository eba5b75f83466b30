"""A corpus in five stages: language, near duplicates, personal data, mix, tokens.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and
returns a DataFrame that is written as Parquet and read as the next stage's docs.
All but the last return the columns of documents.

An empty table stays empty. Texts that are null or have no letter go at the first
stage; every other document is kept but for copies (second stage) and for what the mix
doesn't take (fourth).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.llm import bpe, language, mixing, near_dups, pii
from gaugewell.llm.common import fresh
from gaugewell.plans.bitmap import marked_among
from gaugewell.sources.shared import discard, materialise
from gaugewell.sources.tables import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go; where lang is null, the prediction stands."""
    model = language.learn(docs)
    pred, score = fresh(docs.columns, "pred"), fresh(docs.columns, "score")
    found = language.predict(docs, model, names=(pred, score))
    # nothing labelled to learn from rejects nothing but texts without letters
    rejected = F.col(pred) == "und" if model[0] else ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")
    lang = F.coalesce("lang", F.when(F.col(pred) != "und", F.col(pred)))
    return found.where(~rejected).withColumn("lang", lang).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, and of rows that share an id and the words one row. Other texts of an id are documents of their own.

    Documents whose id has nothing to drop stay where they are; the others, and few more
    that a bitmap can't tell from them, are joined with the groups.
    """
    groups = materialise(near_dups.near_duplicates(docs, names=True).where("doc_id IS NOT NULL"), "stage-groups")
    again = groups.where("kept").groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    touched = materialise(groups.where("NOT kept").select("doc_id").unionAll(again.select("doc_id")).distinct(), "stage-touched")
    some, id_, mark, words, row = (fresh(docs.columns, c) for c in ("some", "id", "mark", "words", "row"))
    marked = marked_among(docs, "doc_id", touched, "doc_id", some)
    alone = marked.where(~F.col(some)).select(docs.columns)
    kept = groups.where("kept").select(F.col("doc_id").alias(id_), F.col("mark").alias(mark), F.col("key").alias(words)).distinct()
    left = marked.where(F.col(some)).join(kept.hint("merge"), (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(mark)))
    one = left.groupBy(id_, words).agg(F.min(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
    return alone.unionAll(one.select(docs.columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed spans become <KIND>; n_chars is counted again."""
    clean = pii.redact_pii(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words: taken / size, of which the fraction counts in that share of documents, by a hash."""
    key, mine, times, copy = (fresh(docs.columns, c) for c in ("key", "mine", "times", "copy"))
    taken = mixing.mix(docs, key_col=key).where("taken > 0")
    share = F.pmod(F.xxhash64(F.lit("times"), F.col(key)), F.lit(1 << 20)) / float(1 << 20)
    taken = taken.select(F.col(key), F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + share).cast("int").alias(times)).where(F.col(times) > 0)
    taken = taken.groupBy(key).agg(F.max(times).alias(times))  # rows that repeat lie side by side
    repeated = docs.withColumn(mine, mixing.order_key()).join(taken, F.col(mine) == F.col(key))
    return repeated.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document (unsigned 32-bit, little-endian), their number, and the digest of the text that they decode to."""
    out = bpe.encode(docs.select("doc_id", "text"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]
#: Learned language models, sketches and the merge automaton have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes when the next one's has been written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
