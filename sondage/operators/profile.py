"""Profiling of tables: histograms, requirements, inferred types, dependencies and keys (AG1-AG7, AG21-AG22, SF12, PF1-PF6, PF15, PF18).

A null is a value of its own in dependencies and keys; histograms and types read values as text and skip nulls.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of inferred types, in the order in which they are tried.
TYPE_PATTERNS = (
    ("integer", r"-?\d+"),
    ("decimal", r"-?\d+\.\d+"),
    ("date", r"\d{4}-\d{2}-\d{2}"),
    ("datetime", r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2})?"),
    ("time", r"\d{2}:\d{2}(:\d{2})?"),
)


def long_form(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep..., column, value): every value as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("pair")).select(*keep, "pair.column", "pair.value")


def value_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """AG2: (column, value, n)."""
    return long_form(df, columns).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))


def requirements(histogram: DataFrame, least: int = 2) -> DataFrame:
    """AG3: how often a sample must show each value."""
    return histogram.select("column", "value", F.least(F.lit(least), "n").cast("bigint").alias("required"))


def distinct_profile(df: DataFrame, columns: list[str], most: int = 50) -> DataFrame:
    """AG1, AG21, FIL6, PF18: distinct values and mean length of each column, and whether it is a coverage target."""
    per_value = value_histogram(df, columns)
    return per_value.groupBy("column").agg(
        F.count("*").alias("distinct_values"), F.sum(F.length("value") * F.col("n")).cast("bigint").alias("total_length"), F.sum("n").alias("values")
    ).withColumn("is_target", F.col("distinct_values") <= most)


def group_contribution(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """AG4: how often each group shows each value."""
    return long_form(df, columns, keys).where("value is not null").groupBy(*keys, "column", "value").agg(F.count("*").alias("n"))


def infer_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """SF12: (column, inferred): the first pattern that all non-empty values match, varchar if none; integer for a column without values."""
    values = long_form(df, columns)
    fits = [F.coalesce(F.bool_and(F.when(F.col("value") != "", F.col("value").rlike(rf"^(?:{pattern})\z"))), F.lit(True)).alias(name) for name, pattern in TYPE_PATTERNS]
    found = values.groupBy("column").agg(*fits)
    label = F.coalesce(*[F.when(F.col(name), F.lit(name)) for name, _ in TYPE_PATTERNS], F.lit("varchar"))
    return found.select("column", label.alias("inferred"))


def single_fds(df: DataFrame, columns: list[str]) -> DataFrame:
    """PF1, PF2: (lhs, rhs) of the exact dependencies between single columns.

    A unique column determines all others, so only the other columns are tested as determinants, in one shuffle: every row
    becomes one row a determinant, and the map side keeps the least and greatest value of all columns for each of its values.
    Hot values combine before the shuffle, and nothing is expanded for each pair of columns.
    """
    value = lambda c: F.col(f"`{c}`").cast("string")
    rows = df.select(*[value(c).alias(f"y{i}") for i, c in enumerate(columns)])
    n = len(columns)
    singles = column_counts(df, columns)
    whole = max((r["rows"] for r in singles.values()), default=0)
    unique = [i for i, c in enumerate(columns) if singles[c]["distinct_rows"] == whole]
    tested = [i for i in range(n) if i not in unique]
    schema = "lhs string, rhs string"
    known = df.sparkSession.createDataFrame([(columns[i], columns[k]) for i in unique for k in range(n) if i != k and whole], schema)
    if not tested or not whole:
        return known
    heads = F.explode(F.array(*[F.struct(F.lit(i).alias("x"), F.col(f"y{i}").alias("v")) for i in tested]))
    parts = [f(f"y{i}").alias(f"{a}{i}") for i in range(n) for a, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]
    groups = rows.select(heads.alias("head"), *[f"y{i}" for i in range(n)]).groupBy("head.x", "head.v").agg(F.count("*").alias("rows"), *parts)
    constant = [(F.col(f"lo{i}").eqNullSafe(F.col(f"hi{i}")) & F.col(f"n{i}").isin(0, F.col("rows"))) for i in range(n)]
    holds = groups.groupBy("x").agg(*[F.bool_and(ok).alias(f"ok{i}") for i, ok in enumerate(constant)])
    edges = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("y"), F.col(f"ok{i}").alias("ok")) for i in range(n)]), lambda e: e["ok"]))
    name = F.array(*map(F.lit, columns))
    found = holds.select("x", edges.alias("e")).where("x != e.y").select(name[F.col("x")].alias("lhs"), name[F.col("e.y")].alias("rhs"))
    return found.unionByName(known)


def column_counts(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """For each column its rows, distinct values (a null is one) and the greatest number of rows of a value; one aggregate a column, combined on the map side."""
    parts = [df.groupBy(F.col(f"`{c}`").alias("v")).agg(F.count("*").alias("n")).agg(F.lit(i).alias("i"), F.count("*").alias("distinct_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most")) for i, c in enumerate(columns)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return {columns[r["i"]]: r.asDict() for r in whole.collect()}


def fd_violations(df: DataFrame, lhs: list[str], rhs: list[str]) -> DataFrame:
    """PF3-PF5: determinant values with more than one dependent tuple, with the number of tuples and the least one."""
    dependent = F.struct(*rhs)
    return df.groupBy(*lhs).agg(F.count_distinct(dependent).alias("variants"), F.min(dependent).alias("example")).where("variants > 1")


#: A value is hot if it has more than this share of all rows; its rows are shuffled by whole combinations, not by the value.
HOT_SHARE = 0.01


def combination_counts(df: DataFrame, combos: list[tuple[str, ...]], singles: dict[str, dict]) -> dict[tuple[str, ...], int]:
    """The distinct tuples of each combination.

    Combinations share shuffles: those that contain the column of most distinct values are counted on rows distributed by that
    column, in one shuffle of the rows, and so on for the rest. Rows of its hot values (at most 1 / ``HOT_SHARE`` values) take
    another way: combined on the map side and distributed by whole tuples.
    """
    found = dict.fromkeys(combos, 0)
    left = list(combos)
    for pivot in sorted({c for combo in combos for c in combo}, key=lambda c: (-singles[c]["distinct_rows"], c)):
        mine = [c for c in left if pivot in c]
        left = [c for c in left if pivot not in c]
        if not mine:
            continue
        used = sorted({c for combo in mine for c in combo})
        rows = df.select(F.col(f"`{pivot}`").alias("pivot"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(used)])
        tuples = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[(F.col(f"c{i}") if c in combo else F.lit(None)).cast("string").alias(f"v{i}") for i, c in enumerate(used) if c != pivot]) for k, combo in enumerate(mine)])).alias("t")
        keys = ["pivot", "t.k", *[f"t.v{i}" for i, c in enumerate(used) if c != pivot]]
        count = lambda part: part.select("pivot", tuples).groupBy(*keys).agg(F.lit(1).alias("one")).groupBy("k").agg(F.count("*").alias("n"))
        limit = max(1000, int(singles[pivot]["rows"] * HOT_SHARE))
        if singles[pivot]["most"] > limit:
            hot = [r[0] for r in rows.groupBy("pivot").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("pivot").collect()]
            is_hot = F.coalesce(F.col("pivot").isin([h for h in hot if h is not None]), F.lit(False)) | (F.col("pivot").isNull() if None in hot else F.lit(False))
            counts = count(rows.where(~is_hot).repartition("pivot")).unionByName(count(rows.where(is_hot)))
        else:
            counts = count(rows.repartition("pivot"))
        for k, n in counts.groupBy("k").agg(F.sum("n")).collect():
            found[mine[k]] = n
    return found


def unique_combinations(df: DataFrame, columns: list[str], most: int = 2, accepted: list[list[str]] = ()) -> DataFrame:
    """AG22, PF6, PF15, ST7: (columns, size, distinct_rows, rows, is_unique) of all combinations up to ``most``; those that contain an accepted key are left out.

    Level by level: a combination that contains a unique one is unique and not counted.
    """
    singles = column_counts(df, columns)
    rows = max((s["rows"] for s in singles.values()), default=0)
    combos = [c for size in range(1, most + 1) for c in combinations(columns, size) if not any(set(k) <= set(c) for k in accepted)]
    unique = [{c} for c in columns if singles[c]["distinct_rows"] == rows]
    found = {(c,): singles[c]["distinct_rows"] for c in columns}
    for size in range(2, most + 1):
        level = [c for c in combos if len(c) == size]
        found |= {c: rows for c in level if any(u <= set(c) for u in unique)}
        found |= combination_counts(df, [c for c in level if c not in found], singles)
        unique += [set(c) for c in level if found[c] == rows]
    out = [(", ".join(c), len(c), found[c], rows, found[c] == rows, i) for i, c in enumerate(combos)] if rows else []
    return df.sparkSession.createDataFrame(out, "columns string, size int, distinct_rows bigint, rows bigint, is_unique boolean, position int")


def minimal_unique_combination(df: DataFrame, columns: list[str], most: int = 3) -> list[str]:
    """PF15, SO5: the first unique combination by size and column order; all columns if none of up to ``most`` is."""
    singles = column_counts(df, columns)
    rows = max((s["rows"] for s in singles.values()), default=0)
    for size in range(1, most + 1):
        level = list(combinations(columns, size))
        counts = {(c,): singles[c]["distinct_rows"] for c in columns} if size == 1 else combination_counts(df, level, singles)
        first = next((c for c in level if counts[c] == rows), None)
        if first:
            return list(first)
    return list(columns)
