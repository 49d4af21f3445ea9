"""The corpus pipeline: filter, dedup, decontaminate and mix ``documents``.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of ``docs``; the last returns the mix, a row per
document with the words that the mix takes from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import jaccard, leaks, lines, mixing, toxicity
from threadloom.llm.store import kept, table
from threadloom.session import configure


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject. A document with a null id is kept."""
    configure(spark)
    scored = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return docs.join(scored.where("predicted = 1").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows. Documents of which no line is left go.

    Columns of ``docs`` that are named like the operator's own counts step aside while it runs.
    """
    configure(spark)
    aside = {c: f"_own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    cleaned = lines.dedup_lines(docs.withColumnsRenamed(aside))
    left = cleaned.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return left.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links."""
    configure(spark)
    return jaccard.jaccard_join(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    configure(spark)
    return leaks.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes from each document."""
    configure(spark)
    return mixing.taken_words(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
]

# No SQL can state the trained models and the latent search of the stages; tests hold them against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
