"""Queries of the general record problems: parsing (p2) and orphans (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import orphans, records
from sondage.session import table


def export_records(spark: SparkSession, sf: str, recovered: bool = False) -> DataFrame:
    """export_rows read under its contract; the dataset names are a bounded list of the reference table."""
    datasets = [r[0] for r in table(spark, sf, "ref_entities").select("dataset").distinct().collect() if r[0]]
    return records.parse_records(table(spark, sf, "export_rows"), "row_id", "row_text", records.export_contract(datasets), recovered)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return export_records(spark, sf).where("reason is not null").select("row_id", "reason")


def p2_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Valid rows, and the valid records that were read after a broken one in rejected rows (part from 1)."""
    return records.typed_export(export_records(spark, sf, True))


def p2_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected rows with the place of the fault and the number of valid records recovered from them."""
    return export_records(spark, sf).where("reason is not null").select("row_id", "reason", "at", "line", "col", "place", "recovered")


def _records(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [table(spark, sf, t) for t in ("parsed_records", "metrics_records", "raw_records")]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.record_orphans(*_records(spark, sf)).select("tbl", F.col("rec_id").cast("bigint").alias("rec_id"), "ref", "state")


def p4_periods(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphans_per_period(*_records(spark, sf))


def p4_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Runs per month whose prompt isn't among those without a dictionary; a tenth of all runs share one prompt, so this takes the heavy way too."""
    refs = table(spark, sf, "raw_records").select(F.col("raw_id").alias("rec_id"), F.col("prompt_file").alias("key"), F.col("loaded_at").alias("at"))
    parents = table(spark, sf, "prompts").where("NOT dictionary").select(F.col("prompt_file").alias("key"), F.lit(None).cast("timestamp").alias("since"), F.lit(False).alias("deleted"))
    return orphans.orphan_counts(refs, parents)


QUERIES = {"p2_found": p2_found, "p2_valid": p2_valid, "p2_faults": p2_faults, "p4_found": p4_found, "p4_periods": p4_periods, "p4_prompts": p4_prompts}
SQL = {"p4_prompts": "SELECT strftime(loaded_at, '%Y-%m') AS period, 'missing' AS state, count(*) AS orphans FROM raw_records WHERE prompt_file IS NOT NULL AND prompt_file NOT IN (SELECT prompt_file FROM prompts WHERE NOT dictionary) GROUP BY ALL"}
