"""The operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import (
    embedding_join,
    filter_audit,
    fingerprints,
    importance,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    ppm,
    quality,
    sql,
    toxicity,
    url_filter,
    warc,
)
from pagewright.storage import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_lempel_ziv_fingerprints")
def lempel_ziv_fingerprints(spark, sf):
    return fingerprints.neighbour_fingerprints(table(spark, sf, "documents"))


@query("op2_ngram_jaccard_join")
def ngram_jaccard_join(spark, sf):
    return ngram_join.similar_documents(table(spark, sf, "documents"))


@query("op3_toxicity")
def score_toxicity(spark, sf):
    return toxicity.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op4_ppm_scores")
def ppm_scores(spark, sf):
    return ppm.score(table(spark, sf, "documents"))


@query("op5_line_dedup", sql.LINE_DEDUP)
def dedup_lines(spark, sf):
    kept = line_dedup.dedup_lines(table(spark, sf, "documents"))
    return kept.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_poisson_mixing", sql.POISSON_MIXING)
def poisson_mixing(spark, sf):
    mixed = mixing.replicated(table(spark, sf, "documents"))
    return mixed.select(
        "doc.doc_id", "doc.source", F.round("rate", 9).alias("rate"), "copies", "copy", "place", F.md5("doc.text").alias("text_md5")
    )


@query("op7_url_vocabulary", sql.URL_VOCABULARY)
def url_vocabulary(spark, sf):
    judged = url_filter.judge_urls(table(spark, sf, "pages"))
    terms = {c: F.array_join(c, ",") for c in ("strict_terms", "soft_terms")}
    return judged.withColumns(terms)


@query("op8_warc_dictionary", sql.WARC_DICTIONARY)
def warc_dictionary(spark, sf):
    path = shared_path(spark)
    warc.write_archives(table(spark, sf, "pages"), path)
    return warc.read_archives(spark, path).drop("payload", "url")


@query("op9_packing")
def pack(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


@query("op10_weak_supervision")
def weak_supervision(spark, sf):
    return quality.judge(table(spark, sf, "documents"))


@query("op11_filter_audit", sql.FILTER_AUDIT)
def audit_filters(spark, sf):
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op12_importance_resampling", sql.IMPORTANCE)
def importance_resampling(spark, sf):
    return importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op13_grid_order_join")
def grid_order_join(spark, sf):
    return embedding_join.near_duplicates(table(spark, sf, "embeddings"))
