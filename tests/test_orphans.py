import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sondage.operators.orphans import dangling_ends, orphan_counts, orphan_references, orphans_per_period, record_orphans

T0 = datetime(2025, 1, 1)


def brute(refs, parents):
    out = set()
    for rid, key, at in refs:
        if key is None:
            continue
        mine = [p for p in parents if p[0] == key]
        if not mine:
            out.add((rid, "missing"))
        elif any(d for _, _, d in mine):
            out.add((rid, "deleted"))
        elif at is not None and min(s for _, s, _ in mine) > at:
            out.add((rid, "late"))
    return out


def test_orphans_match_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    parents = [(f"k{rng.randint(0, 30)}", T0 + timedelta(days=rng.randint(0, 30)), rng.random() < 0.1) for _ in range(60)]
    refs = [(i, None if rng.random() < 0.05 else ("hot" if i % 3 == 0 else f"k{rng.randint(0, 50)}"), None if rng.random() < 0.05 else T0 + timedelta(days=rng.randint(0, 30))) for i in range(400)]
    r = spark.createDataFrame([(*x, "clash") for x in refs], "rec_id long, key string, at timestamp, state string").drop("state")
    p = spark.createDataFrame(parents, "key string, since timestamp, deleted boolean")
    for heavy in (50, 10**9):
        assert {(x.rec_id, x.state) for x in orphan_references(r, p, heavy).collect()} == brute(refs, parents)
        counts = {(x.period, x.state): x.orphans for x in orphan_counts(r, p, heavy).collect()}
        wanted = {}
        for rid, state in brute(refs, parents):
            at = refs[rid][2]
            wanted[at and at.strftime("%Y-%m"), state] = wanted.get((at and at.strftime("%Y-%m"), state), 0) + 1
        assert counts == wanted
    assert orphan_references(r.limit(0), p).count() == 0
    assert {x.state for x in orphan_references(r, p.limit(0)).collect()} == {"missing"}


def test_ends_by_canonical_name(spark):
    e = "array<struct<name: string>>"
    r = "array<struct<frm: string, to: string>>"
    rows = [
        (1, T0, [("Order",), ("line items",)], [("orders", "LineItem"), ("Ghost", "Order")]),
        (2, T0, None, [("A", None)]),
        (3, T0, [("A",)], None),
        (4, T0, [(None,), ("Ａ",)], [("a", "A")]),
    ]
    df = spark.createDataFrame(rows, f"parsed_id long, loaded_at timestamp, es {e}, rs {r}")
    found = {(x.rec_id, x.ref) for x in dangling_ends(df, "parsed_id", F.col("es"), F.col("rs")).collect()}
    assert found == {(1, "rel1.frm"), (2, "rel0.frm"), (2, "rel0.to")}


def test_whole_tables(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    found = record_orphans(t("parsed_records"), t("metrics_records"), t("raw_records"))
    assert found.count() == found.dropDuplicates(["tbl", "rec_id", "ref"]).count() > 0
    periods = orphans_per_period(t("parsed_records"), t("metrics_records"), t("raw_records"))
    assert periods.agg(F.sum("orphans")).first()[0] == found.count()
