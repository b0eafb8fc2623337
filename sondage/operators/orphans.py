"""References to records that do not exist: orphans in a referencing table, with their state, and their counts per period.

Skew-aware split: references are first aggregated per key and month, so a hot key is a few rows after the map side. Keys that
have more than ``HEAVY_SHARE`` of all references are heavy; there are at most 1 / ``HEAVY_SHARE`` of them, and they meet their
parents by broadcast. All other keys meet the parents in a shuffled anti-join (missing) and join (deleted, late). The counts
of both are united. Where rows are asked for, only suspect keys and months return to theirs, heavy ones by broadcast again, and the
healthy heavy keys never reach a shuffle.

Defined results: a null reference refers to nothing and is no case; a null time of the row is never ``late``; an empty
parent table makes every reference ``missing``; repeated parents count once, by their earliest time; deleted once is
deleted. Only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.text import canon
from sondage.session import checkpoint

#: A key with more than this share of all references, and at least so many, is heavy.
HEAVY_SHARE, HEAVY_ROWS = 0.001, 1000


def _period(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM"), F.lit(""))


def suspect_keys(refs: DataFrame, parents: DataFrame, heavy_rows: int | None = None) -> DataFrame:
    """(key, period, n, heavy, state, partly, since): the keys and months of ``refs`` that have orphans; ``partly`` if only the rows before ``since`` are."""
    counts = refs.where("key is not null").groupBy("key", _period(F.col("at")).alias("period")).agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    counts = checkpoint(counts)
    totals = counts.groupBy("key").agg(F.sum("n").alias("total"))
    limit = heavy_rows if heavy_rows is not None else max(HEAVY_ROWS, int((counts.agg(F.sum("n")).first()[0] or 0) * HEAVY_SHARE))
    heavy = F.broadcast(checkpoint(totals.where(F.col("total") >= limit).select("key")))  # at most rows / limit keys
    known = parents.where("key is not null").groupBy("key").agg(F.min("since").alias("since"), F.coalesce(F.max("deleted"), F.lit(False)).alias("deleted"))
    lost = F.when(F.col("deleted"), "deleted").when(F.col("since") > F.col("first"), "late")

    def states(part: DataFrame, there: DataFrame, is_heavy: bool) -> DataFrame:
        missing = part.join(there, "key", "left_anti").select("key", "period", "n", F.lit("missing").alias("state"), F.lit(False).alias("partly"), F.lit(None).cast("timestamp").alias("since"))
        found = part.join(there, "key").withColumn("state", lost).where("state is not null")
        partly = (F.col("state") == "late") & ~(F.col("since") > F.col("last"))
        return missing.unionByName(found.select("key", "period", "n", "state", partly.alias("partly"), F.col("since").cast("timestamp").alias("since"))).withColumn("heavy", F.lit(is_heavy))

    few = F.broadcast(checkpoint(known.join(heavy, "key", "left_semi")))  # a row a heavy key at most
    return checkpoint(states(counts.join(heavy, "key", "left_anti"), known, False).unionByName(states(counts.join(heavy, "key", "left_semi"), few, True)))


def _rows(refs: DataFrame, suspects: DataFrame) -> DataFrame:
    """The rows of suspect keys and months, with their state."""
    rows = refs.where("key is not null").select("rec_id", "key", "at", _period(F.col("at")).alias("period"))
    on, light, heavy = ["key", "period"], suspects.where("not heavy"), F.broadcast(suspects.where("heavy"))  # a row a heavy key and month
    kept = ["rec_id", "key", "at", "period", "state", "partly", "since"]
    found = rows.join(light, on).select(*kept).unionByName(rows.join(heavy, on).select(*kept))
    return found.where("not partly or since > at").select("rec_id", "key", "at", "period", "state")


def orphan_references(refs: DataFrame, parents: DataFrame, heavy_rows: int | None = None) -> DataFrame:
    """The rows of ``refs`` (rec_id, key, at) whose key isn't among ``parents`` (key, since, deleted), with ``state``.

    state: missing (no parent), deleted (a parent of the key is), late (the earliest parent came after the row).
    """
    return _rows(refs, suspect_keys(refs, parents, heavy_rows)).drop("period")


def orphan_counts(refs: DataFrame, parents: DataFrame, heavy_rows: int | None = None) -> DataFrame:
    """(period, state, orphans) per month; rows are counted by key and month, and only read again where a parent came within the month."""
    suspects = suspect_keys(refs, parents, heavy_rows)
    whole = suspects.where("not partly").select("period", "state", "n")
    part = _rows(refs, suspects.where("partly")).groupBy("period", "state").agg(F.count("*").alias("n"))
    period = F.when(F.col("period") != "", F.col("period")).alias("period")
    return whole.unionByName(part).groupBy(period, "state").agg(F.sum("n").alias("orphans"))


def dangling_ends(df: DataFrame, key: str, entities: Column, relationships: Column) -> DataFrame:
    """Ends of a row's relationships that name none of its entities, by canonical name: (key, at, ref).

    Ends that are literally among the names are settled without canonical forms. A null end names nothing and is a case.
    """
    ends = F.flatten(
        F.transform(
            relationships,
            lambda r, i: F.array(
                F.struct(F.concat(F.lit("rel"), i.cast("string"), F.lit(".frm")).alias("ref"), r["frm"].alias("name")),
                F.struct(F.concat(F.lit("rel"), i.cast("string"), F.lit(".to")).alias("ref"), r["to"].alias("name")),
            ),
        )
    )
    names = F.coalesce(F.transform(entities, lambda e: e["name"]), F.array().cast("array<string>"))
    rows = df.select(F.col(key).alias("rec_id"), F.col("loaded_at").alias("at"), names.alias("names"), ends.alias("ends"))
    rows = rows.select("rec_id", "at", "names", F.explode(F.filter("ends", lambda e: ~F.coalesce(F.array_contains(F.col("names"), e["name"]), F.lit(False)))).alias("end"))
    known = F.transform(F.filter("names", lambda n: n.isNotNull()), canon)
    return rows.where(~F.coalesce(F.array_contains(known, canon(F.col("end.name"))), F.lit(False))).select("rec_id", "at", F.col("end.ref").alias("ref"))


def _run_references(parsed: DataFrame, metrics: DataFrame, raw: DataFrame) -> list[tuple[str, DataFrame, DataFrame]]:
    """The references to runs: table, referencing rows, parents."""
    refs = lambda child, key: child.select(F.col(key).alias("rec_id"), F.col("run_id").alias("key"), F.col("loaded_at").alias("at"))
    known = lambda parents, deleted: parents.select(F.col("run_id").alias("key"), F.col("loaded_at").alias("since"), deleted.alias("deleted"))
    return [("parsed_records", refs(parsed, "parsed_id"), known(raw, F.col("deleted_at").isNotNull())), ("metrics_records", refs(metrics, "metrics_id"), known(parsed, F.lit(False)))]


def _ends(parsed: DataFrame) -> DataFrame:
    return dangling_ends(parsed, "parsed_id", F.col("candidate.entities"), F.col("candidate.relationships"))


def record_orphans(parsed: DataFrame, metrics: DataFrame, raw: DataFrame, heavy_rows: int | None = None) -> DataFrame:
    """All orphans of the model records: (tbl, rec_id, ref, state, at)."""
    found = _ends(parsed).select(F.lit("parsed_records").alias("tbl"), "rec_id", "ref", F.lit("missing").alias("state"), "at")
    for tbl, refs, known in _run_references(parsed, metrics, raw):
        found = found.unionByName(orphan_references(refs, known, heavy_rows).select(F.lit(tbl).alias("tbl"), "rec_id", F.lit("run_id").alias("ref"), "state", "at"))
    return found


def orphans_per_period(parsed: DataFrame, metrics: DataFrame, raw: DataFrame, heavy_rows: int | None = None) -> DataFrame:
    """Orphans per table, month of loading, kind of reference and state."""
    month = F.date_format("at", "yyyy-MM").alias("period")
    counts = _ends(parsed).groupBy(month).agg(F.count("*").alias("orphans")).select(F.lit("parsed_records").alias("tbl"), "period", F.lit("relationship").alias("kind"), F.lit("missing").alias("state"), "orphans")
    for tbl, refs, known in _run_references(parsed, metrics, raw):
        counts = counts.unionByName(orphan_counts(refs, known, heavy_rows).select(F.lit(tbl).alias("tbl"), "period", F.lit("run_id").alias("kind"), "state", "orphans"))
    return counts
