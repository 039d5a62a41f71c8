"""The training-data pipeline: toxicity, near-duplicates, secrets, mixing, packing.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the last
return the columns of ``documents``. ``run`` applies them to the documents of a folder.

For every stage: whole texts are read, however long; columns beside those of ``documents`` go through unchanged, whatever
their names (the last stage returns pieces instead); an empty table stays empty. What else holds is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sqlforge.llm import mixing, packing, secrets, simhash, toxicity
from sqlforge.llm.common import documents, materialize, read_table
from sqlforge.llm.tokenize import vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.

    Null and empty texts are scored by the bias alone and stay unless that rejects all; null languages, sources and ids don't matter to the
    score; repeated rows get one score and stay or go together; a score of exactly 0.5 goes; without labels of both
    classes every document has the share of label 1.
    """
    return toxicity.reject_toxic(docs, read_table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Null texts, empty ones and those without a word share the fingerprint 0 and are one group; a null id comes
    after all others; among rows of one id the first stays, so repeated rows leave one.
    """
    return simhash.one_per_group(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of secrets replaced.

    Null texts stay null and empty ones empty; a null source or language is an owner or repository of its own; repeated rows are all kept and
    read alike; n_chars and the other columns stay as they were.
    """
    return secrets.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as often as their source's epochs ask.

    A null source is a source of its own; documents without a word are never taken, and none comes
    out of a table without words; rows alike in id, source and text share one key and are taken alike; the
    document at the end of a budget gives only its first words.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences.

    A null text is an empty one, whose one id is the end mark; null ids come first; repeated rows are packed one after
    another, each with its own pieces; every id lies in exactly one piece.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2)


STAGES = [("toxicity", toxicity_stage), ("simhash near-dedup", simhash_stage), ("secret scans", secrets_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]
# The trained classifier and the fingerprints can't be written in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "pipeline-" + name.split()[0])
    return docs
