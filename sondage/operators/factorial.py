"""Aggregates under a factorial design (AG8-AG15, AG19, AG26, FIL1-FIL3, JN2, PRJ4, SO2, TS5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_sd(value: Column) -> Column:
    """AG8: the sample standard deviation, 0 for one value, null for none."""
    return F.when(F.count(value) == 1, F.lit(0.0)).otherwise(F.stddev_samp(value))


def long_scores(metrics: DataFrame, keep: list[str], dimensions: tuple[str, ...] = ("entities", "relationships", "keys", "attributes")) -> DataFrame:
    """(keep..., dim, precision, recall, f1): a row a run and dimension."""
    parts = F.array(*[F.struct(F.lit(d).alias("dim"), *[F.col(f"metrics.{d}.{m}").alias(m) for m in ("precision", "recall", "f1")]) for d in dimensions])
    return metrics.select(*keep, F.explode(parts).alias("s")).select(*keep, "s.dim", "s.precision", "s.recall", "s.f1")


def cell_summary(metrics: DataFrame, cell: list[str]) -> DataFrame:
    """AG9: runs, parse failures, mean and deviation of each measure per cell and dimension."""
    scores = long_scores(metrics, [*cell, "parse_failure"])
    found = [f(F.col(m)).alias(f"{m}_{n}") for m in ("precision", "recall", "f1") for n, f in (("mean", F.avg), ("sd", sample_sd))]
    return scores.groupBy(*cell, "dim").agg(F.count("*").alias("n"), F.count_if("parse_failure").alias("parse_failures"), *found)


def main_effects(metrics: DataFrame, by: list[str], factors: tuple[str, ...] = ("domain", "dictionary", "rules"), headers: str = "meaningful", temperature: float = 0.0) -> DataFrame:
    """AG10, FIL1-FIL2: mean F1 without and with each factor, and the difference, in one aggregate."""
    rows = long_scores(metrics.where((F.abs(F.col("temperature") - temperature) < 1e-9) & (F.col("headers") == headers)), [*by, *factors])
    sums = [F.avg(F.when(F.col(f) == on, F.col("f1"))).alias(f"{f}_{n}") for f in factors for on, n in ((False, "off"), (True, "on"))]
    wide = rows.groupBy(*by, "dim").agg(*sums)
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"{f}_off").alias("off"), F.col(f"{f}_on").alias("on")) for f in factors])).alias("e")
    return wide.select(*by, "dim", parts).select(*by, "dim", "e.factor", F.col("e.off").alias("mean_off"), F.col("e.on").alias("mean_on"), (F.col("e.on") - F.col("e.off")).alias("delta"))


def header_means(metrics: DataFrame, by: list[str], temperature: float = 0.0) -> DataFrame:
    """AG11: mean F1 per level of headers."""
    rows = long_scores(metrics.where(F.abs(F.col("temperature") - temperature) < 1e-9), [*by, "headers"])
    return rows.groupBy(*by, "headers", "dim").agg(F.count("f1").alias("n"), F.avg("f1").alias("mean_f1"))


def token_totals(raw: DataFrame) -> DataFrame:
    """AG12: runs and tokens in total and per provider and dataset, in one pass."""
    tokens = raw.select("provider", "dataset", F.coalesce("usage.input_tokens", F.lit(0)).alias("i"), F.coalesce("usage.output_tokens", F.lit(0)).alias("o"))
    grouped = tokens.groupingSets([[], ["provider", "dataset"]], "provider", "dataset")
    return grouped.agg(F.count("*").alias("runs"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), (F.sum("i") + F.sum("o")).alias("total_tokens"), F.grouping_id().cast("int").alias("level"))


def stability(raw: DataFrame, cell: list[str]) -> DataFrame:
    """AG14, SF22: repeated runs of a cell, how many texts differ, and how many agree with another."""
    digest = F.sha2(F.coalesce("response_text", F.lit("")), 256)
    found = raw.groupBy(*cell).agg(F.count("*").alias("n"), F.count_distinct(digest).alias("distinct_outputs"))
    return found.withColumn("all_identical", F.col("distinct_outputs") == 1).withColumn("identical_outputs", F.col("n") - F.col("distinct_outputs") + 1)


def within_cell_sd(metrics: DataFrame, cell: list[str], by: list[str]) -> DataFrame:
    """TS5, AG19: mean over cells of the deviation between replicates; cells of one run have none and are counted."""
    scores = long_scores(metrics, list(dict.fromkeys([*cell, *by])))
    cells = scores.groupBy(*dict.fromkeys([*cell, *by]), "dim").agg(F.stddev_samp("f1").alias("sd"))
    return cells.groupBy(*by, "dim").agg(F.count("*").alias("cells"), F.count("sd").alias("cells_with_sd"), F.avg("sd").alias("mean_sd"))


def with_model(df: DataFrame, models: dict[str, str]) -> DataFrame:
    """PRJ4, JN2: ``df`` with ``model``, the configured model of each provider, or the provider's name if it has none."""
    known = F.create_map(*[F.lit(x) for pair in models.items() for x in pair]) if models else F.from_json(F.lit("{}"), "map<string,string>")
    return df.withColumn("model", F.coalesce(F.try_element_at(known, F.col("provider")), F.col("provider")))


def cell_count(metrics: DataFrame, cell: list[str]) -> DataFrame:
    """AG13: the number of cells and of runs in them."""
    return metrics.groupBy(*cell).agg(F.count("*").alias("n")).agg(F.count("*").alias("cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("runs"))


def replicate_lists(metrics: DataFrame, cell: list[str]) -> DataFrame:
    """AG15: F1 of each cell's replicates, in their order; a cell has as many as the design says."""
    rows = long_scores(metrics, [*cell, "replicate"]).where("f1 is not null")
    return rows.groupBy(*cell, "dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("replicate", "f1"))), lambda x: x["f1"]).alias("f1s"))


def run_counters(matrix: DataFrame, recorded: DataFrame, failed: Column) -> DataFrame:
    """AG26: of the runs of a matrix, those recorded (done), recorded without an answer (failed) and not recorded (pending), and all."""
    state = recorded.groupBy("run_id").agg(F.bool_and(failed).alias("failed"))
    joined = matrix.select("run_id").join(state, "run_id", "left")
    return joined.agg(
        F.count_if(F.col("failed") == F.lit(False)).alias("done"), F.count_if(F.coalesce("failed", F.lit(False))).alias("failed"), F.count_if(F.col("failed").isNull()).alias("pending"), F.count("*").alias("total")
    )


def sorted_cube(cube: DataFrame, cell: list[str]) -> DataFrame:
    """SO2: a cube in the order of its keys."""
    return cube.orderBy(*cell)
