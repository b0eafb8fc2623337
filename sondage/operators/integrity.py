"""Referential integrity and coverage checks (JN5, JN16, PRJ1, ST1-ST3, ST6, SNK8, SNK10) as findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def projection(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """PRJ1: distinct rows of the mapped columns, renamed."""
    return df.select(*[F.col(f"`{column}`").alias(name) for name, column in mapping.items()]).distinct()


def stack(projections: list[DataFrame]) -> DataFrame:
    """ST1: role projections under each other, each distinct, the whole not."""
    return reduce(DataFrame.unionByName, projections)


def dangling(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """JN5, ST3: distinct child tuples, without nulls, that no parent has; ``keys`` maps child columns to the parent's."""
    left = projection(child, {c: c for c in keys}).dropna()
    right = projection(parent, {c: p for c, p in keys.items()})
    return left.join(right, list(keys), "left_anti")


def inclusions(checks: list[tuple[str, DataFrame, DataFrame, dict[str, str]]]) -> DataFrame:
    """JN5, SNK10: a finding a check (name, child, parent, keys): dangling tuples, and OK or FAIL. All checks share one shuffle of distinct tuples, children and parents side by side."""

    def side(i: int, df: DataFrame, columns: list[str], is_child: bool) -> DataFrame:
        values = [F.col(f"`{c}`").cast("string").alias(f"k{n}") for n, c in enumerate(columns)]
        known = df.dropna(subset=columns).select(F.lit(i).alias("i"), (values[0] if len(values) == 1 else F.to_json(F.struct(*values))).alias("tuple"))
        return known.withColumn("child", F.lit(is_child)).withColumn("parent", F.lit(not is_child))

    sides = [side(i, df, columns, is_child) for i, (_, child, parent, keys) in enumerate(checks) for df, columns, is_child in ((child, list(keys), True), (parent, list(keys.values()), False))]
    tuples = stack(sides).groupBy("i", "tuple").agg(F.bool_or("child").alias("child"), F.bool_or("parent").alias("parent"))
    lost = tuples.groupBy("i").agg(F.count_if(F.col("child") & ~F.col("parent")).alias("n"))
    names = lost.sparkSession.createDataFrame([(i, name) for i, (name, *_) in enumerate(checks)], "i int, check string")
    found = names.join(lost, "i", "left").select("check", F.coalesce("n", F.lit(0)).alias("dangling"))
    return found.withColumn("status", F.when(F.col("dangling") == 0, "OK").otherwise("FAIL"))


def binding_coverage(binding: DataFrame, attributes: DataFrame, columns: DataFrame) -> DataFrame:
    """JN16, ST6: attributes that no binding maps, and bound columns that the table lacks: (entity, name, problem)."""
    unbound = attributes.join(binding, ["entity", "attribute"], "left_anti").select("entity", F.col("attribute").alias("name"), F.lit("unbound attribute").alias("problem"))
    unknown = binding.join(columns, "column", "left_anti").select("entity", F.col("column").alias("name"), F.lit("unknown column").alias("problem"))
    return unbound.unionByName(unknown)


def verify(expected: DataFrame, made: DataFrame) -> DataFrame:
    """SNK8: OK, MISMATCH, MISSING or EXTRA for each name, by digest."""
    e, m = expected.select("name", F.col("sha256").alias("expected")), made.select("name", F.col("sha256").alias("made"))
    status = F.when(F.col("made").isNull(), "MISSING").when(F.col("expected").isNull(), "EXTRA").when(F.col("made") == F.col("expected"), "OK").otherwise("MISMATCH")
    return e.join(m, "name", "full").select("name", status.alias("status"))
