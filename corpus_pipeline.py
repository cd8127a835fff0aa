"""From documents to a training mix: score, thin near copies, cut repeats, decontaminate, mix.

Every stage takes what the one before kept. The first four return the columns of ``documents``; the
last returns them with ``copy``, a row for every time the mix takes a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseframe.llm import decontaminate, mixture, near_copies as copies, quality_fm, suffix_dedup
from pulseframe.llm.base import store, table

#: Documents that score lower are rejected.
QUALITY = 0.3
#: Bytes from which a string that occurs twice is cut: less than any 50 words take.
REPEATED = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labelled ones among them."""
    machine = quality_fm.fit(docs, table(spark, sf_dir, "labels"))
    return quality_fm.score(docs, machine, "_score").filter(f"_score >= {QUALITY}").drop("_score")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of every group of near copies: linked by fingerprints that differ in
    two bits at most (``simhash``), or by five-word shingles of similarity 0.8."""
    return copies.keep_one(docs, fingerprints=True)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that lie in strings of ``REPEATED`` bytes found elsewhere too."""
    return suffix_dedup.without_repeats(docs, REPEATED)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in windows of benchmark items."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of each document that bring its source to its target."""
    return mixture.mix(docs)


STAGES = [("quality", quality), ("near copies", near_copies), ("repeats", repeats), ("contamination", contamination), ("mixing", mixing)]

#: The learned and the hashed stages have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written as Parquet in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
