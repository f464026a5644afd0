"""The corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, mix.

Each stage takes (spark, docs, sf_dir) and returns a table; run() writes each
stage's rows as Parquet in the shared folder and gives the next stage what was
written. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm import near_copies, op04_quality, op05_mixing, op06_decontamination, op10_pii
from lakemill.llm.common import stored, table


def unused(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """These names, with more underscores where the documents have such a column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return tuple(out)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    net = op04_quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    names = unused(docs, "quality_score", "quality_accepted")
    scored = op04_quality.score_quality(docs, net, names=names)
    return scored.where(F.col(names[1]) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    names = unused(docs, "leak_item", "leak_share", "leak_found")
    marked = op06_decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"), names=names)
    return marked.where(~F.col(names[2])).select(*(F.col(f"`{c}`") for c in docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return op10_pii.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: every document with the words taken of it and its training position, in training order; documents' text goes along."""
    mixed = op05_mixing.mix_documents(docs, keep_text=True)
    return op05_mixing.in_training_order(mixed)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

#: The learned, graph and text stages have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a data folder through all stages."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
