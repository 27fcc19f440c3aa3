"""Queries of the problems on text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import abuse, mixing, packing, parsing, splitting, terms


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(table(spark, d, "snippet_text"), table(spark, d, "snippets"), table(spark, d, "piece_limits"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(p2_pieces(spark, d))


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    return splitting.checks(p2_pieces(spark, d), table(spark, d, "snippets"), table(spark, d, "piece_limits"))


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_scores(table(spark, d, "snippet_text"), "snippet_id", "text")


def p5_top_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.top_terms(p5_scores(spark, d), "snippet_id")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "container_specs"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_containers(spark, d), table(spark, d, "container_specs"))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    return packing.checks(table(spark, d, "documents"), p6_containers(spark, d), table(spark, d, "container_specs"))


def p7_uses(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    return mixing.checks(p7_uses(spark, d), table(spark, d, "mix_targets"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.bad_files(table(spark, d, "snippet_text"), table(spark, d, "snippets")).select("repo", "file_path")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.bad_rates(table(spark, d, "snippet_text"), table(spark, d, "snippets"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return abuse.score_documents(docs, abuse.fit(docs, table(spark, d, "doc_labels")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where("flagged").select("doc_id").distinct()


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    return abuse.checks(table(spark, d, "documents"), p8_scores(spark, d))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(p8_scores(spark, d))


QUERIES = {
    "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_checks": p2_checks, "p3_found": p3_found, "p3_rates": p3_rates, "p5_scores": p5_scores, "p5_top_terms": p5_top_terms,
    "p6_containers": p6_containers, "p6_fill": p6_fill, "p6_checks": p6_checks, "p7_uses": p7_uses, "p7_shares": p7_shares, "p7_checks": p7_checks,
    "p8_found": p8_found, "p8_scores": p8_scores, "p8_checks": p8_checks, "p8_rates": p8_rates,
}
ORACLE = {**splitting.SQL, **terms.SQL, **packing.SQL, **mixing.SQL, **abuse.SQL}
