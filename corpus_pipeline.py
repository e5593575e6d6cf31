"""A training corpus from raw documents: quality rules, exact and near deduplication, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmatch.llm import bpe, exact, mixing, near, quality, simhash
from quillmatch.llm.common import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, with all columns, repeated rows too. Null texts count as empty, and empty ones go."""
    return quality.keep_good(docs, rules=quality.KEEP)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: the longest, then the smallest id, null last.

    Null texts are equal to empty ones; of rows repeated whole one stays. All columns stay.
    """
    return exact.drop_exact_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id, null last, of each group of near duplicates.

    Texts are linked by SimHash, two or fewer differing bits, by the operator of ``simhash``; and, as near copies of some words lie further apart,
    by exact similarity of 0.8 or more of their shingles of five words. A group is what both kinds of links reach. Texts without words are near duplicates of each other. Rows that are equal in id and text stay together. All columns stay.
    """
    scratch = Scratch(spark)
    prints = scratch.keep(simhash.grouped(docs).select("doc_id", "_row_hash", "root"), "simhash")
    return near.drop_near_duplicates(docs, grouped=prints)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so rows repeat, with all columns. A missing source is a source of its own."""
    return mixing.mixed(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, ids_sha256, decoded_sha256) for each row, repeated ones too; null and empty texts have no tokens."""
    return bpe.encoded(docs, keep=("source",), ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: SQL cannot say near deduplication, which follows links of links between fingerprints, or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents; each but the last is written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
