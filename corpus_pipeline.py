"""The corpus pipeline: quality rules, near-dedup, suffix-array dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept. All but the last return the columns
of ``documents``; the last returns the packing plan of what is left. ``run`` writes each stage's result as Parquet in the shared checkpoint
folder and reads it again for the next.

Defined results of all stages: an empty table gives an empty result; extra columns go along up to the last stage; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from punctaria.llm import decontamination, near_dedup, packing, quality_rules, suffix_dedup
from punctaria.llm.common import discard, materialise, read


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts have too few words and go; of repeated rows each is judged, with the same verdict."""
    return quality_rules.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: those that share 80 % of their five-word shingles. Of rows with
    equal ids one stays; null and empty texts, and rows with a null id, are linked with nothing and stay; ties go to
    the smallest id."""
    return near_dedup.keep_one(docs, 80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without long strings that occur earlier, by id and place. Rows of equal id and text are one document; documents that lose all
    but white space go, null and empty texts have no repeats and stay."""
    return suffix_dedup.remove_repeats(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item. Null and empty texts have no windows and stay; an empty benchmark, or items without words, drop nothing."""
    return decontamination.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing plan: bucket, batch and place of each document; null and empty texts are in the first bucket at length 1; repeated rows are each packed."""
    return packing.query(docs)


STAGES = [
    ("quality_rules", good_documents),
    ("minhash_near_dedup", distinct_documents),
    ("suffix_array_dedup", without_repeats),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

#: Signatures, suffix order and tokens cannot be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's result is deleted when the next one is written; the packing plan holds counts of its own."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    plan = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)
    return plan
