from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from sondage.operators import audit, dependencies, design, factorial, profile, sampling, scoring, stats
from sondage.sources import tables
from sondage.streaming import runs


def test_exact_p_equals_enumeration(spark):
    for n in (1, 4, 7):
        rows = [("g", float(i + 1) * (-1 if i % 3 == 1 else 1), 0.0) for i in range(n)]
        found = stats.wilcoxon(spark.createDataFrame(rows, "k string, l double, r double"), ["k"], "l", "r").first()
        least = min(found.w_plus, found.w_minus)
        sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in product((0, 1), repeat=n)]
        assert found.p == pytest.approx(min(1.0, 2 * sum(t <= least for t in sums) / 2**n))


def test_ties_and_zeros_take_the_normal_tail(spark):
    rows = [("g", 1.0, 0.0), ("g", -1.0, 0.0), ("g", 2.0, 0.0), ("g", 3.0, 3.0)]
    found = stats.wilcoxon(spark.createDataFrame(rows, "k string, l double, r double"), ["k"], "l", "r").first()
    assert found.n == 3 and found.pairs == 4 and found.p == pytest.approx(0.4142, abs=1e-3)  # 2 * normal tail of (1.5 - 3) / sqrt((84 - 3) / 24)


@pytest.mark.parametrize("hot", [0, 3000])
def test_combination_counts_with_hot_values_and_nulls(spark, hot):
    rows = [(i % 37 if i % 5 else None, i // 3, "x" if i % 2 else None) for i in range(400)] + [(7, i % 11, str(i % 4)) for i in range(hot)]
    df = spark.createDataFrame(rows, "a int, b int, c string")
    found = {r["columns"]: (r.distinct_rows, r["rows"], r.is_unique) for r in profile.unique_combinations(df, ["a", "b", "c"], 3).collect()}
    for size in (1, 2, 3):
        for combo in combinations(range(3), size):
            distinct = len({tuple(r[i] for i in combo) for r in rows})
            assert found[", ".join("abc"[i] for i in combo)] == (distinct, len(rows), distinct == len(rows))
    assert profile.unique_combinations(df.limit(0), ["a", "b"], 2).count() == 0


def test_equal_columns_have_one_representative(spark):
    facts = spark.createDataFrame([("m", c, w) for c, w in (("id", 4.0), ("name", 9.0), ("no", 4.0), ("city", 1.0), ("rest", 2.0))], "model string, column string, mean_length double")
    pairs = [(x, y) for x in ("id", "name", "no") for y in ("id", "name", "no", "city") if x != y]
    edges = spark.createDataFrame([("m", *p) for p in pairs], "model string, lhs string, rhs string")
    found = {r.column: r.stands_for for r in dependencies.representatives(facts, edges).collect()}
    assert found == {"id": "id", "name": "id", "no": "id", "city": "city", "rest": "rest"}


def test_audit_findings(spark):
    df = spark.createDataFrame([(1, "a", 10, 1, "x"), (2, "b", 10, 3, "y"), (3, "b", 20, 9, "y")], "k int, n string, g int, ref int, t string")
    model = audit.Model(
        [audit.Entity("Thing", ("key", "name", "group"), ("key",), (("name",),), ({"key": "k", "name": "n", "group": "g"},)), audit.Entity("Unbound", ("a",), ("a",))],
        [audit.Reference("points", "Thing", ("key",), "Thing", ("key",))],
    )
    found = {(r.check, r.subject): (r.status, r.detail) for r in audit.audit(df, model).collect()}
    assert found["bound", "Unbound"] == ("FAIL", 0) and found["key determines", "Thing (key)"] == ("OK", 0) and found["key determines", "Thing (name)"] == ("FAIL", 1)
    assert found["reference", "points: Thing -> Thing"] == ("OK", 0) and not any(check == "accidental key" for check, _ in found)
    wrong = audit.Model([audit.Entity("Thing", ("key",), ("key",), (), ({"key": "gone"},))])
    assert {(r.check, r.status) for r in audit.audit(df, wrong).collect()} == {("bound", "OK"), ("columns exist", "FAIL"), ("attributes mapped", "OK")}
    empty = {r.status for r in audit.audit(df.limit(0), model).collect()}
    assert "FAIL" in empty  # the unbound entity


def test_missing_alias_file_is_none(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"entities": [{"name": "Order", "primaryKey": ["id"], "attributes": [{"name": "id"}]}], "relationships": []}')
    entities, links = tables.read_reference(spark, str(tmp_path / "m.json"), "d")
    assert entities.first().aliases == [] and links.first().links == []
    refs = scoring.references(entities)
    assert refs.first().reference[0]["keys"] == [[["id"]]]


def test_texts_are_read_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\n")
    assert tables.read_texts(spark, str(tmp_path)).first().text == "one\n\ntwo\n"
    tables.write_prompts(spark.createDataFrame([("n", "a\nb")], "name string, text string"), str(tmp_path / "out"))
    assert [tuple(r) for r in tables.read_prompts(spark, str(tmp_path / "out")).collect()] == [("n", "a\nb")]


def test_samples_keep_the_order_of_the_file(spark):
    df = spark.createDataFrame([(i, i % 5, "v") for i in range(40)], "place int, g int, v string").repartition(4)
    rows = sampling.sample_rows(df, ["g"], [("3",), ("1",)], "place").collect()
    assert [r.place for r in rows] == [i for i in range(40) if i % 5 in (1, 3)]
    assert [(r.g, r.first_row) for r in sampling.group_rows(df, ["g"], "place").orderBy("first_row").collect()] == [(i, i) for i in range(5)]


def test_models_by_provider(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "provider string")
    assert [r.model for r in factorial.with_model(df, {"a": "m1"}).collect()] == ["m1", "b", None]
    assert [r.model for r in factorial.with_model(df, {}).collect()] == ["a", "b", None]


def test_blocks_stand_before_the_format(spark):
    text = design.render(F.lit("A\n\nOUTPUT FORMAT\n{{DATA_BLOCK}}"), design.knowledge_blocks(F.lit("x"), F.lit("- c: y"), F.array(F.lit("r")), (F.lit(True), F.lit(False), F.lit(True))), design.data_block(F.array(F.lit("id")), F.array(F.lit("1")), "none"))
    found = spark.range(1).select(text.alias("t")).first().t
    assert found.startswith("A\n\nDOMAIN CONTEXT") and "- r\n\nOUTPUT FORMAT\nThe following" in found and found.endswith("c1\n1") and "DICTIONARY" not in found


@pytest.mark.parametrize("ahead", [1, 3, 200])
def test_cover_equals_the_plain_greedy_one(spark, monkeypatch, ahead):
    """Step by step: each time the open group of the largest gain, ties to the least key, no group twice."""
    monkeypatch.setattr(sampling, "AHEAD", ahead)
    rows = [(g, f"v{(g * 7 + i * i) % 9}", f"w{(g * i) % 5}") for g in range(25) for i in range(g % 5 + 1)]
    need: dict = {}
    for _, a, b in rows:
        for v in (("a", a), ("b", b)):
            need[v] = need.get(v, 0) + 1
    need = {v: min(2, n) for v, n in need.items()}
    groups = {str(g): [v for h, a, b in rows if h == g for v in (("a", a), ("b", b))] for g in range(25)}
    wanted = []
    while any(n > 0 for n in need.values()):
        gain = {g: sum(min(own.count(v), max(0, need[v])) for v in set(own)) for g, own in groups.items()}
        best = min(groups, key=lambda g: (-gain[g], g))
        if gain[best] <= 0:
            break
        wanted.append((best,))
        for v in groups.pop(best):
            need[v] -= 1
    assert sampling.greedy_cover(spark.createDataFrame(rows, "g int, a string, b string"), ["g"], ["a", "b"]) == wanted


def test_rates_of_arriving_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, (provider, minute, text) in enumerate((("a", 5, "x"), ("a", 50, " "), ("b", 5, None), ("a", 70, "y"))):
        (tmp_path / "in" / f"{i}.json").write_text('{"run_id": "%d", "provider": "%s", "generated_at": "2025-01-01T%02d:%02d:00"%s}' % (i, provider, 10 + minute // 60, minute % 60, "" if text is None else f', "response_text": "{text}"'))
    stream = runs.failure_rates(runs.read_arriving(spark, str(tmp_path / "in"), tables.RAW))
    stream.writeStream.outputMode("complete").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    found = {(r.provider, r.window.start.hour): (r["runs"], r.empty_answers) for r in spark.table("rates").collect()}
    assert sorted(found.values()) == [(1, 0), (1, 1), (2, 1)] and {p for p, _ in found} == {"a", "b"}
