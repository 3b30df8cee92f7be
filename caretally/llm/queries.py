"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from caretally.llm import classlm, decontam, huffman, langid, neardup, packing, quality, ranked, runs, suffix, toxicity, urls, warc


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark, sf_dir):
    return huffman.round_trip(read(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_suffix_array_dedup(spark, sf_dir):
    return suffix.deduplicated(read(spark, sf_dir, "documents"))


def op4_warc(spark, sf_dir):
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op5_toxicity(spark, sf_dir):
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_language_id(spark, sf_dir):
    return langid.predictions(read(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark, sf_dir):
    return packing.packed(read(spark, sf_dir, "documents")).withColumn("piece", F.col("piece").cast("int"))


def op8_quality_rules(spark, sf_dir):
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_url_filter(spark, sf_dir):
    return urls.judge_urls(read(spark, sf_dir, "pages"))


def op10_near_duplicates(spark, sf_dir):
    return neardup.classified(read(spark, sf_dir, "documents"))


def op11_class_lm(spark, sf_dir):
    return classlm.scored(read(spark, sf_dir, "documents"))


def op12_ranked_search(spark, sf_dir):
    return ranked.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark, sf_dir):
    return runs.collapsed(read(spark, sf_dir, "documents"), plant=True)


QUERIES = {f.__name__: f for f in (op1_token_output, op2_decontamination, op3_suffix_array_dedup, op4_warc, op5_toxicity, op6_language_id, op7_best_fit_packing, op8_quality_rules, op9_url_filter, op10_near_duplicates, op11_class_lm, op12_ranked_search, op13_periodic_runs)} | {"pipeline": corpus_pipeline.run}
ORACLE = {"op2_decontamination": decontam.ORACLE, "op4_warc": warc.ORACLE, "op9_url_filter": urls.ORACLE, "op10_near_duplicates": neardup.ORACLE, "op12_ranked_search": ranked.ORACLE}
