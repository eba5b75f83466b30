"""Queries opN_<name> over the whole tables, and SQL for their rows where SQL can express them."""

from __future__ import annotations

from gaugewell.llm import ann, bpe, cap_join, language, lm_score, mixing, near_dups, pii, secrets, token_files
from gaugewell.sources.shared import new_path
from gaugewell.sources.tables import table


def op1_token_files(spark, sf_dir):
    path = new_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, end_id=2)
    return token_files.digest(token_files.read(spark, path))


def op2_nearest(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op3_near_dups(spark, sf_dir):
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_secrets(spark, sf_dir):
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op6_bpe(spark, sf_dir):
    return bpe.digest(table(spark, sf_dir, "documents"))


def op7_embedding_links(spark, sf_dir):
    return cap_join.embedding_links(table(spark, sf_dir, "embeddings"))


def op8_lm_score(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.score(table(spark, sf_dir, "documents"), good)


def op9_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op10_pii(spark, sf_dir):
    return pii.pii_digest(pii.detect_pii(table(spark, sf_dir, "documents")))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    own = (op1_token_files, op2_nearest, op3_near_dups, op4_mixing, op5_secrets, op6_bpe, op7_embedding_links, op8_lm_score, op9_language, op10_pii, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql():
    return {"op4_mixing": mixing.oracle(), "op7_embedding_links": cap_join.oracle(), "op10_pii": pii.oracle()}
