"""From raw documents to packed sequences: five stages, each written as Parquet and reread as the next one's documents.

Rows: null, empty and letterless texts go in the first stage. Of rows equal in doc_id and word set one stays, of other copies the one
with the least doc_id; other texts under a repeated doc_id stay, and of copies without any doc_id one. Very long texts are read whole. Ties go to the
smaller doc_id, null counting as the smallest. Columns of any name are passed through, but for the text and n_chars, which follow what
is cut out. Empty documents give an empty result; without benchmark items no document goes for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caretally.llm import decontam, langid, neardup, packing, suffix
from caretally.llm.store import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those whose language is unclear, go."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.deduplicated(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier too are cut out of the texts; every document stays."""
    return suffix.cleaned(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    return packing.packed(docs)


STAGES = [("language ID", language_id), ("MinHash near-dedup", near_dedup), ("suffix-array dedup", suffix_dedup),
          ("benchmark decontamination", decontamination), ("best-fit packing", best_fit_packing)]

#: Language identification and packing cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir))
    return docs
