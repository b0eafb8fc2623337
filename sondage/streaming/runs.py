"""Structured Streaming over arriving run records: parsing and scoring are stateless, so any stream of records is a plan of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators.dsl import parse_models
from sondage.operators.scoring import score_models


def read_arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of JSON records from the files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def scored_stream(records: DataFrame, reference: DataFrame) -> DataFrame:
    """Parsed and scored records, as they arrive; ``reference`` is a static table."""
    parsed = parse_models(records.select("run_id", "provider", "dataset", "generated_at", "response_text"), "response_text")
    return score_models(parsed, reference).select("run_id", "provider", "dataset", "generated_at", "parse.parse_failure", "scores")


def failure_rates(records: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Runs and empty answers per provider and window of generation; records later than the watermark are left out of closed windows."""
    timed = records.withColumn("at", F.to_timestamp("generated_at")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "provider").agg(F.count("*").alias("runs"), F.count_if(F.trim(F.coalesce("response_text", F.lit(""))) == "").alias("empty_answers"))


def start(df: DataFrame, folder: str, checkpoint: str, once: bool = True):
    """Appends to Parquet with exactly-once checkpoints; ``once`` handles what is there and stops."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
