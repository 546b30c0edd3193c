"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from marginalia.llm import language, licences, matrices, packing, pieces, quality, simhash, substrings, topk, urls
from marginalia.llm.shared import load


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.deduplicate(load(spark, sf_dir, "documents")))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(licences.scan(load(spark, sf_dir, "documents")))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(load(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(load(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(load(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_digest(packing.pack(load(spark, sf_dir, "documents")))


def op8_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.digest(matrices.pack_rows(load(spark, sf_dir, "documents")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out()))
    held_out = language.held_out()
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(load(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_substrings, op3_licences, op4_topk, op5_quality, op6_sentencepiece, op7_packing, op8_matrices, op9_language, op10_urls, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_substrings": substrings.SQL, "op5_quality": quality.sql(), "op3_licences": licences.sql(), "op4_topk": topk.SQL, "op10_urls": urls.SQL}
