"""The corpus pipeline: quality, near-duplicates, secrets, mixing, tokens.

Each stage reads what the one before has kept, written as Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import near_copies, op1_secrets, op5_quality, op6_mixing, op8_bpe
from auditloom.llm.shared import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts, with the labels of ``sf_dir``; without labels all of them.

    Nulls in any column, empty, repeated and very long texts are scored like others; rows with equal texts, sources,
    languages and lengths stay or go together. Empty table: no rows. Other columns pass through.
    """
    return op5_quality.accept(docs, op5_quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), the one with the least doc_id.

    SimHash with pigeonring filtering gives candidates, and minima of the shingles those that lie beyond its bits; the
    similarity of each is counted. A null text is an empty one, and texts without words are copies of each other. Rows
    with a null or repeated doc_id are documents of their own. Very long texts: whole. Ties: the least hash of the text;
    equal rows: one of them. Empty table: no rows. Other columns pass through, whatever their names.
    """
    return near_copies.distinct_rows(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced and n_chars counted anew.

    Null and empty texts stay as they are, very long ones are scanned whole, repeated rows are changed alike. Empty table:
    no rows. Other columns pass through.
    """
    return op1_secrets.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 2 times), copies one after the other.

    A null text has no words, a null source is a source of its own; documents without words go along with whole passes.
    Ties: the seeded hash; which of two equal rows is taken makes no difference. Empty table: no rows. Other columns pass
    through, whatever their names.
    """
    return op6_mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix.

    A null text is an empty one without tokens; very long texts go in blocks; repeated rows have a row each, encoded once
    where they follow each other. Empty table: no rows. Other columns are not read.
    """
    return op8_bpe.encode_digest(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("tokens", tokens)]

#: SQL can express none of the stages' learned or hashed decisions; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
