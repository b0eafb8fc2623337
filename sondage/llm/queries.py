"""Queries of the language-model problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm import abuse, encode, mapping, mixing, pairs, truncation
from sondage.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, sf, "raw_records"), table(spark, sf, "prompts"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated_runs(table(spark, sf, "raw_records"), table(spark, sf, "prompts"))


def p3_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, sf, "raw_records"), table(spark, sf, "prompts"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.map_entities(table(spark, sf, "parsed_records"), table(spark, sf, "ref_entities")).select("parsed_id", "pos", "entity_ref")


def p5_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Names without an entry, with the number of their uses."""
    found = mapping.map_entities(table(spark, sf, "parsed_records"), table(spark, sf, "ref_entities"))
    return found.where("entity_ref = 0").groupBy("dataset", "name").agg(F.count("*").alias("uses"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode(table(spark, sf, "documents"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.report(*mixing.copies(table(spark, sf, "documents"), table(spark, sf, "mix_targets")))


def p7_full_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares of a mix as large as all documents of the target sources: small sources are used up to their cap and fall short."""
    return mixing.report(*mixing.copies(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), portion=1.0))


def p7_copies(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.copies(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.score_documents(table(spark, sf, "documents"), table(spark, sf, "abuse_samples"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p8_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The offending sentences of the documents that have any."""
    return _scored(spark, sf).select("doc_id", "score", F.explode("offending").alias("sentence"))


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.abuse_rates(_scored(spark, sf))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_rates": p3_rates, "p5_found": p5_found, "p5_unmatched": p5_unmatched, "p6_ids": p6_ids, "p7_shares": p7_shares, "p7_full_shares": p7_full_shares, "p7_copies": p7_copies, "p8_found": p8_found, "p8_sentences": p8_sentences, "p8_rates": p8_rates}
SQL: dict[str, str] = {}
