"""The corpus pipeline: quality rules, quality classifier, near-duplicates, packing. Each stage works on all that the one before kept.

Null and empty texts have too few words and go with the first stage; repeated rows (equal key and text) stay once after the third.
An empty table gives an empty result of the same columns; other columns are kept as they came, whatever their names, until the
last stage, whose rows are pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mapweave.llm import fm_classifier, packing, quality_rules, simhash
from mapweave.llm.common import fresh_name, table, written


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the log-likelihood ratio keep."""
    verdict = fresh_name(docs, "verdict_of_rules")
    judged = quality_rules.quality_rules(docs, table(spark, sf_dir, "labels"), into=verdict)
    return judged.filter(f"{verdict}.kept").drop(verdict)


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least one half. The model is fitted on labelled ones of the whole corpus: the rules let hardly any of quality 0 come here."""
    model = fm_classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = fresh_name(docs, "score_of_classifier")
    return fm_classifier.score(docs, model, into=score).filter(f"{score} >= 0.5").drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8."""
    return simhash.deduplicate(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", keep_by_rules), ("quality classifier", keep_by_classifier), ("near duplicates", drop_near_duplicates), ("packing", pack_sequences)]

#: SQL has no XXH64, logistic fit or linear program to give these rows; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
