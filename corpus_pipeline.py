"""The pipeline from raw documents to packed sequences: each stage reads what its predecessor kept.

All stages take nulls in any column, empty and very long texts, ties, repeated rows, extra columns of any name and empty
tables: rows with a null or blank text go in the first stage; rows with a null doc_id are kept by near-duplicates and
substring dedup as they are; repeated rows are near-duplicates of each other; an empty table gives an empty one. All stages
but the last return the columns of their input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import jaccard, language, packing, quality, substrings
from marginalia.llm.shared import load, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines; n_chars follows. Null and blank texts go."""
    return quality.clean(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, by a model of the labelled ones among them; a null lang gets it. Texts without letters go, and all texts if no document has a label."""
    return language.keep_identified(docs, language.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest doc_id: shingles of five words, a similarity of 0.8 or more, each link verified. Operator 1 gives the candidates (near fingerprints by Golay keys); pairs that fingerprints of 64 bits can't find come from an exact join (README)."""
    return jaccard.drop_near_duplicates(docs, shingle=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words and more that an earlier one has; those that lose all go."""
    return substrings.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; every document is in them once, also one with an empty text."""
    return packing.with_digest(packing.pack(docs))


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("near-duplicates", near_duplicates), ("substring dedup", substring_dedup), ("packing", packed)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""

    def step(docs: DataFrame, stage: tuple) -> DataFrame:
        return materialise(stage[1](spark, docs, sf_dir), stage[0].replace(" ", "-").lower())

    return reduce(step, STAGES, load(spark, sf_dir, "documents").select(F.col("*")))
