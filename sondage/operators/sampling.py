"""Deterministic group-preserving coverage samples (PF19-PF21, SO1, SO6, AG5-AG7, AG27, FIL7, WN9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.operators.profile import distinct_profile, group_contribution, requirements, value_histogram
from sondage.session import checkpoint


def coverage_targets(df: DataFrame, columns: list[str], most: int = 50) -> list[str]:
    """PF18: columns of few distinct values; at most as many names as the schema has."""
    found = {r[0] for r in distinct_profile(df, columns, most).where("is_target").select("column").collect()}
    return [c for c in columns if c in found]


#: Groups of the largest gains that one round reads.
AHEAD = 200


def greedy_cover(df: DataFrame, keys: list[str], targets: list[str], least: int = 2) -> list[tuple]:
    """PF19, SO1: the groups chosen one by one, each of the largest gain, ties to the smallest key as text.

    A round reads the contributions of the ``AHEAD`` groups of largest gain, and chooses among them as long as the best has more
    than the last of them had: gains only fall, so no other group can have as much. What is missing is at most targets x their
    distinct values (bounded by ``coverage_targets``), and a round covers some of it.
    """
    spark = df.sparkSession
    text = df.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], *[c for c in targets if c not in keys])
    given = checkpoint(group_contribution(text, keys, targets))
    missing = {(r[0], r[1]): r[2] for r in requirements(value_histogram(text, targets), least).collect()}
    chosen: list[tuple] = []
    while missing:
        left = spark.createDataFrame([(c, v, n) for (c, v), n in missing.items()], "column string, value string, missing bigint")
        useful = given.join(F.broadcast(left), ["column", "value"])
        if chosen:
            useful = useful.join(F.broadcast(spark.createDataFrame(chosen, ", ".join(f"`{k}` string" for k in keys))), keys, "left_anti")
        best = useful.groupBy(*keys).agg(F.sum(F.least("n", "missing")).alias("gain")).orderBy(F.desc("gain"), *keys).limit(AHEAD)
        offers: dict[tuple, dict] = {}
        first: dict[tuple, int] = {}
        for r in useful.join(F.broadcast(best), keys).select(*keys, "column", "value", "n", "gain").collect():
            key = tuple(r[k] for k in keys)
            offers.setdefault(key, {})[r["column"], r["value"]] = r["n"]
            first[key] = r["gain"]
        if not offers:
            break
        bound = min(first.values()) if len(offers) == AHEAD else 0
        before = len(chosen)
        while offers and missing:
            gain = {key: sum(min(n, missing[v]) for v, n in own.items() if v in missing) for key, own in offers.items()}
            key = min(offers, key=lambda k: (-gain[k], k))
            if gain[key] <= 0 or gain[key] <= bound and len(chosen) > before:
                break
            chosen.append(key)
            for v, n in offers.pop(key).items():
                if v in missing:
                    missing[v] -= n
                    if missing[v] <= 0:
                        del missing[v]
        if len(chosen) == before:
            break
    return chosen


def group_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """AG27, WN9: (keys..., rows, first_row): the groups with the place of their first row, by which they keep the order of the file."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.min(order).alias("first_row"))


def sample_rows(df: DataFrame, keys: list[str], chosen: list[tuple], order: str | None = None) -> DataFrame:
    """FIL7, SO6: the rows of the chosen groups; in the order of the file if ``order`` names the column that has it."""
    names = [f"_key_{i}" for i in range(len(keys))]
    groups = df.sparkSession.createDataFrame(chosen, ", ".join(f"{n} string" for n in names))
    match = F.lit(True)
    for n, k in zip(names, keys, strict=True):
        match = match & (F.col(n) == F.coalesce(F.col(k).cast("string"), F.lit("")))
    kept = df.join(F.broadcast(groups), match, "left_semi")  # at most targets x their values x ``least`` groups are chosen
    return kept.orderBy(order) if order else kept


def representativeness(df: DataFrame, sample: DataFrame, columns: list[str], most: int = 50, least: int = 2) -> DataFrame:
    """PF21: for each column, distinct values and values of at least ``least`` occurrences, in full and in the sample, and AG6 the share of the distinct ones that the sample has."""
    full = value_histogram(df, columns)
    part = value_histogram(sample, columns).withColumnRenamed("n", "m")
    both = full.join(part, ["column", "value"], "left")
    return both.groupBy("column").agg(
        F.count("*").alias("distinct_full"),
        F.count("m").alias("distinct_in_sample"),
        F.count_if(F.col("n") >= least).alias("frequent_full"),
        F.count_if((F.col("n") >= least) & (F.col("m") >= least)).alias("frequent_in_sample"),
        (F.count("*") <= most).alias("is_target"),
    ).withColumn("coverage_pct", F.bround(100.0 * F.col("distinct_in_sample") / F.col("distinct_full"), 1))


def sample_size(df: DataFrame, sample: DataFrame, keys: list[str]) -> DataFrame:
    """AG7: rows and groups, in full and in the sample."""
    count = lambda part, name: part.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_rows"), F.count("*").alias(f"{name}_groups"))
    return count(df, "full").crossJoin(F.broadcast(count(sample, "sample")))  # one row each
