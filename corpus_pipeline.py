"""Corpus cleaning pipeline: quality filter, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again
as the next stage's docs. All but the last keep the columns of ``documents``.

Defined results of all stages: extra columns are carried along untouched (the last stage returns its own
columns only), whatever their names; an empty table gives an empty one; texts are read whole, however long; a row is judged
by its own text, so rows that repeat an id or a text get the same decision. What each stage does with null and empty
texts, null ids and ties is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txgraph.llm import bpe, decontaminate, near_duplicates, quality_classifier, secrets
from txgraph.llm.common import read_table, written
from txgraph.session import remove_scratch, scratch_scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under the threshold) go; a score at the threshold stays.

    Null and empty texts are scored like any text, by statistics of no words. Rows with a null id are scored,
    but never learned from. With labels of one class only, or none, every score is the share of class 1 (0.5 for none)."""
    return quality_classifier.keep_quality(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity 0.8): the one with the smallest id.

    Null texts, empty ones and those without words are linked with nothing and stay, as do rows with a null id. Rows
    that repeat an id and a text become one; rows of one id with different texts stay or go together."""
    return near_duplicates.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents holding a benchmark window go.

    Null and empty texts hold none and stay; null ids play no part. An empty benchmark removes nothing; of an item
    shorter than a window the whole item is one, an item without words is none."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; n_chars follows (0 for a null text). All rows stay.

    Null texts stay null, empty ones empty; of overlapping spans the first names the kind and all their text goes; ids play no part."""
    return secrets.redact_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every kept document: doc_id, n_tokens, digests of ids and of the decoded text.

    One row per row: a null text counts as empty (no tokens, digests of nothing), a null id is kept, repeated rows
    give repeated results."""
    return bpe.bpe_round_trip(docs)


STAGES = [("quality classifier", quality), ("near duplicates", near_dedup), ("decontamination", decontamination), ("secrets", secret_redaction), ("bpe", tokens)]
ORACLE_SQL = None  # no stage but plain filters can be said in SQL; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written before the next stage, and the tables that a stage
    wrote on its way, and its predecessor's result, are removed once its own is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark) as paths:
            docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
            result = paths.pop()  # the last table written
        if before is not None:
            remove_scratch(spark, before)
        before = result
    return STAGES[-1][1](spark, docs, sf_dir)
