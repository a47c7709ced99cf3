"""The corpus pipeline: stages over ``documents``, each on all that the one before kept.

quality rules -> n-gram Jaccard join -> benchmark decontamination -> secret scan -> BPE coding. The first three drop
documents, the fourth rewrites texts, the last returns the token ids of what is left. SQL cannot express the stages;
the tests hold each of them against brute force. An empty table passes through all stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import bpe, decontaminate, jaccard_join, quality, secret_scan
from tidewright.llm.common import drop_written, table, written, written_tables


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality posterior passes; rejected ones go.

    Null, empty and short texts (under 50 words) are rejected; repeated rows are judged alike, whatever their id.
    """
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id: five-word shingles, a similarity of 0.8 or more.

    Null and empty texts stay, rows with a null id stay, and of rows with one id one stays.
    """
    return jaccard_join.keep_one(docs, percent=80, k=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item.

    Null, empty and very short texts stay, rows with a null id stay, and rows with one id go together.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with secrets replaced by a mark; n_chars follows the text. Null texts stay null; every row stays."""
    return secret_scan.redact(docs, counted="n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the hash of the decoded text, a row for each row; null and empty texts have no ids."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("BPE encoding and decoding", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again as the next one's input.

    The tables that a stage leaves, and the result of the stage before it, go when its own result is written.
    """
    docs = table(spark, sf_dir, "documents")
    before = written_tables()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
            drop_written(keep=1, before=before)
    return docs
