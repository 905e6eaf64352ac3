"""A corpus from raw documents: toxicity, near duplicates, benchmark leaks, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next one's docs.
All but the last give the columns of documents; the last adds each document's place in the mix.
An empty table gives an empty table in every stage; no stage looks at columns other than doc_id, text and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontaminate, jaccard, mixing, pii, toxicity
from barloom.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on these, rejects go. A null text counts as empty; equal texts
    stay or go together, whatever their ids; without labels of both kinds nothing is learned and the bias decides."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the smallest id (null last), of equal ids the one
    with the least hash of its text, of equal rows one. Rows without words stay."""
    return jaccard.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a test item go. Null and empty texts, and empty items, match nothing."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind in brackets; n_chars follows. Null texts stay null; no row goes."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in a mix of the sources with square-root weights. A null source is one of its own; rows
    with equal ids have places of their own."""
    return mixing.mix(docs, mixing.target_weights(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: SQL can't express the classifier, the field and the verification; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
