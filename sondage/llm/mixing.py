"""Mixing sources to target weights by entropy balancing (p7).

Each document i of source s gets a rate w_i = min(cap_s, exp(lambda_s * t_i / m_s)), t_i being its tokens and m_s their
mean: of all rates with the source's token total, the ones of least relative entropy to one copy each. The multipliers
solve the convex dual; Newton steps need, for each source, the sums of w t and of w t^2 over uncapped documents, which a
distributed aggregate gives over the exact histogram (source, tokens, documents). Rates become copies by systematic
rounding along the documents ordered by tokens, so that a source misses its total by about one document.

The mix is the largest in which all sources that have documents keep their targets among themselves, unless ``tokens`` is
given; a source whose capped supply is below its target is used up and falls short, and its report says so.

Defined results: sources without documents or with a target of 0, null or less get no copies and are reported; documents of
other sources, of null source or without tokens get none; repeated rows are documents of their own; a null or negative cap
counts as 0. Ties are ordered by doc_id.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.llm.encode import token_counts
from sondage.session import checkpoint

#: Newton steps at most and the relative error of a source's tokens at which they end.
STEPS, TOLERANCE = 60, 1e-9
#: Documents of a source are rounded in ranges of token counts, split by digest into so many parts at least, and more parts where one would have so many documents.
PARTS, PART_ROWS = 32, 50_000


def newton_rates(histogram: DataFrame, wanted: dict[str, float], caps: dict[str, float], means: dict[str, float]) -> dict[str, float]:
    """The multiplier of each source: damped Newton steps on the dual, each one aggregate over the histogram."""
    spark = histogram.sparkSession
    rates = dict.fromkeys(wanted, 0.0)
    low, high = dict.fromkeys(wanted, -math.inf), dict.fromkeys(wanted, math.inf)
    open_ = set(wanted)
    for _ in range(STEPS):
        table = spark.createDataFrame([(s, rates[s], float(caps[s]), float(means[s])) for s in sorted(open_)], "source string, rate double, cap double, mean double")
        exponent = F.col("rate") * F.col("tokens") / F.col("mean")
        tilted = F.exp(F.least(exponent, F.lit(60.0)))
        w, x = F.least(F.col("cap"), tilted), F.col("tokens") / F.col("mean")
        sums = (
            histogram.join(F.broadcast(table), "source")  # a row a source
            .groupBy("source")
            .agg(F.sum(F.col("documents") * w * F.col("tokens")).alias("have"), F.sum(F.when(tilted < F.col("cap"), F.col("documents") * w * F.col("tokens") * x).otherwise(0.0)).alias("slope"))
            .collect()
        )
        for source, have, slope in sums:
            gap = wanted[source] - have
            if abs(gap) <= TOLERANCE * wanted[source] or high[source] - low[source] < 1e-12:
                open_.discard(source)
                continue
            if gap > 0:
                low[source] = rates[source]
            else:
                high[source] = rates[source]
            step = rates[source] + (max(-3.0, min(3.0, gap / slope)) if slope > 0 else math.copysign(3.0, gap))
            if not low[source] < step < high[source]:
                step = (low[source] + high[source]) / 2 if math.isfinite(low[source] + high[source]) else step
            rates[source] = max(-600.0, min(600.0, step))
        if not open_:
            break
    return rates


def plan_mix(histogram: DataFrame, targets: DataFrame, tokens: float | None = None) -> list[dict]:
    """A row for each target source: what it has, what it should give and its multiplier."""
    goals = {r[0]: (float(r[1] or 0), max(0, int(r[2] or 0))) for r in targets.where("source is not null").select("source", "target_share", "max_repeats").collect()}
    stock = {r[0]: (float(r[1]), int(r[2])) for r in histogram.where(F.col("source").isin(list(goals))).groupBy("source").agg(F.sum(F.col("tokens") * F.col("documents")), F.sum("documents")).collect()}
    supply = {s: stock.get(s, (0.0, 0))[0] * cap for s, (_, cap) in goals.items()}
    active = {s: share for s, (share, _) in goals.items() if share > 0 and supply[s] > 0}
    total = sum(active.values())
    size = tokens if tokens is not None else min((supply[s] * total / share for s, share in active.items()), default=0.0)
    wanted = {s: min(supply[s], size * share / total) for s, share in active.items()}
    means = {s: stock[s][0] / stock[s][1] for s in active}
    caps = {s: goals[s][1] for s in active}
    full = {s for s in active if wanted[s] >= supply[s] * (1 - 1e-12)}
    rates = newton_rates(histogram, {s: wanted[s] for s in active if s not in full}, caps, means)
    return [
        {"source": s, "target_share": share, "max_repeats": cap, "supply": supply[s], "wanted": wanted.get(s, 0.0), "mean": means.get(s, 1.0), "rate": 600.0 if s in full else rates.get(s, 0.0), "active": s in active}
        for s, (share, cap) in goals.items()
    ]


PLAN = "source string, target_share double, max_repeats bigint, supply double, wanted double, mean double, rate double, active boolean"


def copies(docs: DataFrame, targets: DataFrame, tokens: float | None = None, portion: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, copies) of the documents that are used, and the plan; ``portion`` sets ``tokens`` as a part of all tokens of the target sources."""
    spark = docs.sparkSession
    sized = checkpoint(token_counts(docs.where("source is not null"), ["doc_id", "source"]).where("n_tokens > 0"))
    histogram = checkpoint(sized.groupBy("source", F.col("n_tokens").alias("tokens")).agg(F.count("*").alias("documents")))
    if portion is not None:
        own = histogram.join(F.broadcast(targets.select("source").distinct()), "source")  # a row a target source
        tokens = portion * float(own.agg(F.sum(F.col("tokens") * F.col("documents"))).first()[0] or 0)
    plan = spark.createDataFrame([tuple(row.values()) for row in plan_mix(histogram, targets, tokens)], PLAN)
    parts = max(PARTS, math.ceil((histogram.agg(F.sum("documents")).first()[0] or 0) / PART_ROWS))
    rated = sized.join(F.broadcast(plan.where("active")), "source")  # a row a source
    rate = F.least(F.col("max_repeats").cast("double"), F.exp(F.least(F.col("rate") * F.col("n_tokens") / F.col("mean"), F.lit(60.0))))
    rated = rated.select("doc_id", "source", "n_tokens", rate.alias("w"), F.floor(F.log2("n_tokens") * 4).cast("int").alias("band"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"))
    # Rates are summed along (band, part, tokens, doc_id): first over the groups, of which there are few, then inside each.
    group = ["source", "band", "part"]
    before = W.partitionBy("source").orderBy("band", "part").rowsBetween(W.unboundedPreceding, -1)
    starts = rated.groupBy(*group).agg(F.sum("w").alias("sum")).select(*group, F.coalesce(F.sum("sum").over(before), F.lit(0.0)).alias("start"))
    inside = W.partitionBy(*group).orderBy("n_tokens", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    ends = rated.withColumn("sum", F.sum("w").over(inside)).join(F.broadcast(starts), group)  # sources x bands x parts: a row for 50,000 documents at least, beyond the first thousands
    end = F.round(F.col("start") + F.col("sum"), 6)
    begin = F.round(F.col("start") + F.col("sum") - F.col("w"), 6)
    used = ends.select("doc_id", "source", "n_tokens", (F.floor(end + 0.5) - F.floor(begin + 0.5)).alias("copies"))
    return used.where("copies > 0"), plan


def report(used: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target source: the share reached of all tokens, and whether it falls short."""
    sums = used.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    rows = plan.join(sums, "source", "left").fillna(0, ["documents", "copies", "most_copies", "tokens"])
    total = F.sum("tokens").over(W.partitionBy())  # a row a source
    share = F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0))
    return rows.select("source", "target_share", "max_repeats", "documents", "copies", "most_copies", "tokens", share.alias("reached_share"), (F.col("supply")).cast("bigint").alias("available_tokens"), (share < F.col("target_share") * 0.995).alias("short"))
