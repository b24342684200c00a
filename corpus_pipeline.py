"""From raw documents to a training mix: quality, rules, near-duplicates, benchmark leaks, source weights."""

from __future__ import annotations

from pulsegrid.llm import byte_cnn, decontam, mixing, rule_ledger, scratch, signature_tree
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _by_place(docs: DataFrame) -> tuple[DataFrame, list[str], str]:
    """The documents with columns named by their places and the text once more, the names, and the text's: so no column clashes with what an operator adds."""
    names = [f"column{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names).withColumn("whole", F.col(names[docs.columns.index("text")])), names, "whole"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (probability 0.5 or more)."""
    net = byte_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, names, text = _by_place(docs)
    return byte_cnn.score(plain, net, text=text).where("score >= 0.5").select(*names).toDF(*docs.columns)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the production policy."""
    plain, names, text = _by_place(docs)
    return rule_ledger.ledger(plain, text=text).where(rule_ledger.passes("web-2")).select(*names).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles link at a similarity of 0.8: the one with the smallest id."""
    return signature_tree.one_per_component(docs, shingle=5, num=4, den=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each remaining document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("quality rules", rules_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: Classifier and hash choices have no counterpart in SQL; tests/llm/test_pipeline.py holds the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the written result of the one before.

    Null and empty texts are scored by the classifier as they are; the rules reject them.
    Rows without an id are judged by their texts; of repeated rows one stays; an empty table
    gives an empty result; further columns of any name reach the last stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            before, docs = docs, scratch.written(docs, f"stage{k}")
            scratch.drop(before)
    return docs
