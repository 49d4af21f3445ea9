"""The registered queries of the corpus operators: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import chat, edits, jaccard, leaks, licenses, lines, merkle, mixing, periods, privacy, tokens, toxicity, vectors
from threadloom.llm.store import table
from threadloom.session import configure

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {"op6_line_dedup": lines.ORACLE, "op9_mixing": mixing.ORACLE, "op11_merkle_manifest": merkle.ORACLE}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[fn.__name__] = fn
    return fn


@query
def op1_embedding_dedup(spark, sf_dir):
    configure(spark)
    return vectors.vector_components(table(spark, sf_dir, "embeddings"))


@query
def op2_jaccard_join(spark, sf_dir):
    configure(spark)
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark, sf_dir):
    configure(spark)
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_token_counts(spark, sf_dir):
    configure(spark)
    return tokens.token_counts(table(spark, sf_dir, "documents"))


@query
def op5_license_scan(spark, sf_dir):
    configure(spark)
    return licenses.license_summary(table(spark, sf_dir, "documents"))


@query
def op6_line_dedup(spark, sf_dir):
    configure(spark)
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


@query
def op7_decontamination(spark, sf_dir):
    configure(spark)
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_role_repair(spark, sf_dir):
    configure(spark)
    return chat.repaired(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "new_role", "action", "inserted", "rendered")


@query
def op9_mixing(spark, sf_dir):
    configure(spark)
    return mixing.taken_words(table(spark, sf_dir, "documents"))


@query
def op10_personal_data(spark, sf_dir):
    configure(spark)
    return privacy.personal_data_summary(table(spark, sf_dir, "documents"))


@query
def op11_merkle_manifest(spark, sf_dir):
    configure(spark)
    return merkle.manifest_check(table(spark, sf_dir, "documents"))


@query
def op12_edit_fingerprints(spark, sf_dir):
    configure(spark)
    return edits.edit_summary(table(spark, sf_dir, "documents"))


@query
def op13_periodic_runs(spark, sf_dir):
    configure(spark)
    return periods.run_summary(table(spark, sf_dir, "documents"))
