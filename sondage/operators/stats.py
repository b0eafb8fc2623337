"""Rank tests on paired cells (TS1-TS4, WN8, AG16-AG18, JN13, JN14).

Ranks are windows over the pairs of one group; a group is one comparison (model x dataset x dimension), whose cells the
design bounds. p values need the normal tail, which SQL lacks: an Arrow function on one row a group.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Pairs up to which p is exact, if none is zero and none ties.
EXACT = 50


def average_rank(by: list[str], value: Column) -> Column:
    """WN8: ranks from 1, equal values sharing the mean of their ranks."""
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if x is None or math.isnan(x) else math.erfc(abs(x) / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def exact_p(n: pd.Series, w: pd.Series) -> pd.Series:
    """TS2: two-sided exact p of the lesser rank sum of n pairs without ties: subsets of the ranks 1..n by their sum."""

    def tail(pairs: int, least: float) -> float:
        counts = [1] + [0] * (pairs * (pairs + 1) // 2)
        for rank in range(1, pairs + 1):
            for total in range(len(counts) - 1, rank - 1, -1):
                counts[total] += counts[total - rank]
        return min(1.0, 2 * sum(counts[: int(least) + 1]) / 2**pairs)

    return pd.Series([None if pd.isna(a) or pd.isna(b) else tail(int(a), b) for a, b in zip(n, w, strict=True)], dtype="float64")


def wilcoxon(pairs: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """TS1, TS2: signed ranks of left - right per group: pairs, non-zero pairs, median difference, W+, W-, z and p; p is 1 if no pair differs.

    p is exact up to ``EXACT`` pairs without zeros and ties, and asymptotic without continuity correction otherwise.
    """
    d = pairs.where(f"{left} is not null and {right} is not null").select(*by, (F.col(left) - F.col(right)).alias("d"))
    medians = d.groupBy(*by).agg(F.count("*").alias("pairs"), F.median("d").alias("median_delta"))
    ranked = d.where("d != 0").withColumn("a", F.abs("d"))
    ranked = ranked.withColumn("rank", average_rank(by, F.col("a"))).withColumn("ties", F.count("*").over(W.partitionBy(*by, "a")))
    sums = ranked.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"),
        F.sum(F.col("ties") * F.col("ties") - 1).cast("double").alias("tie_sum"),
    )
    n = F.col("n").cast("double")
    spread = (n * (n + 1) * (2 * n + 1) - F.col("tie_sum") / 2) / 24
    z = F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4, F.sqrt(spread))
    key = [F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    out = medians.alias("m").join(sums.alias("s"), key, "left").select(*[F.col(f"m.{c}") for c in by], "pairs", "median_delta", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), F.coalesce("w_minus", F.lit(0.0)).alias("w_minus"), z.alias("z"), "tie_sum")
    exact = (F.col("n") > 0) & (F.col("n") <= EXACT) & (F.col("n") == F.col("pairs")) & (F.coalesce("tie_sum", F.lit(1.0)) == 0)
    p = F.coalesce(F.when(exact, exact_p(F.when(exact, F.col("n")), F.when(exact, F.least("w_plus", "w_minus")))), two_sided_p("z"), F.lit(1.0))
    return out.withColumn("p", p).drop("tie_sum")


def friedman(blocks: DataFrame, by: list[str], block: list[str], treatment: str, value: str, levels: int = 3) -> DataFrame:
    """TS3: Q over complete blocks of ``levels`` treatments with ties corrected, and p = exp(-Q/2) for three treatments."""
    full = blocks.withColumn("k", F.count("*").over(W.partitionBy(*by, *block))).where(F.col("k") == levels)
    ranked = full.withColumn("rank", average_rank([*by, *block], F.col(value))).withColumn("ties", F.count("*").over(W.partitionBy(*by, *block, value)))
    per = ranked.groupBy(*by, treatment).agg(F.sum("rank").alias("_sum"), F.count("*").alias("_blocks"), F.sum(F.col("ties") * F.col("ties") - 1).cast("double").alias("_ties"))
    k = float(levels)
    sums = per.groupBy(*by).agg(F.max("_blocks").alias("n"), F.sum(F.col("_sum") * F.col("_sum")).alias("squares"), F.sum("_ties").alias("_ties"))
    n = F.col("n").cast("double")
    q = F.try_divide(12 / (n * k * (k + 1)) * F.col("squares") - 3 * n * (k + 1), 1 - F.col("_ties") / (n * k * (k * k - 1)))
    out = sums.select(*by, "n", q.alias("q"))
    return out.withColumn("p", F.exp(-F.col("q") / 2)) if levels == 3 else out


def temperature_cells(scores: DataFrame, cell: list[str], levels: tuple[float, ...] = (0.0, 0.2, 0.5)) -> DataFrame:
    """JN14, AG16: mean F1 of each cell at each temperature, one row a cell; null where a cell has none."""
    means = [F.avg(F.when(F.abs(F.col("temperature") - t) < 1e-9, F.col("f1"))).alias(f"t{round(t * 10):02d}") for t in levels]
    return scores.groupBy(*cell).agg(*means)


def temperature_effect(scores: DataFrame, by: list[str], cell: list[str], levels: tuple[float, ...] = (0.0, 0.2, 0.5)) -> DataFrame:
    """TS4, AG17, AG18: per group, over cells that have all temperatures: cells, grand means at the first and the last, median difference, Wilcoxon p between them, Friedman p over all."""
    names = [f"t{round(t * 10):02d}" for t in levels]
    full = temperature_cells(scores, [*by, *cell], levels).dropna(subset=names)
    for name in names:
        full = full.withColumn(name, F.round(name, 9))  # equal means must tie
    first, last = names[0], names[-1]
    means = full.groupBy(*by).agg(F.count("*").alias("cells"), F.avg(first).alias("grand_mean_first"), F.avg(last).alias("grand_mean_last"))
    signed = wilcoxon(full.withColumn(first, F.round(F.col(first) - F.col(last), 9)).withColumn(last, F.lit(0.0)), by, first, last).select(*by, (-F.col("median_delta")).alias("median_delta"), F.col("p").alias("wilcoxon_p"))
    blocks = full.select(*by, *cell, F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(n).alias("f")) for n in names])).alias("b")).select(*by, *cell, "b.level", "b.f")
    ranks = friedman(blocks, by, cell, "level", "f", len(levels)).select(*by, "q", *(["p"] if len(levels) == 3 else []))
    return means.join(signed, by).join(ranks.withColumnRenamed("p", "friedman_p").withColumnRenamed("q", "friedman_q"), by)


def model_cells(scores: DataFrame, cell: list[str], left: str, right: str) -> DataFrame:
    """JN13: mean F1 of two providers in each cell."""
    return scores.where(F.col("provider").isin(left, right)).groupBy(*cell).agg(F.avg(F.when(F.col("provider") == left, F.col("f1"))).alias("left_f1"), F.avg(F.when(F.col("provider") == right, F.col("f1"))).alias("right_f1"))
