import pytest
from pyspark.sql import functions as F

from sondage.operators import dependencies, design, dsl, profile, sampling, scoring, stats, synth
from sondage.sources import tables
from sondage.streaming import runs

TEXT = """Here is my answer:
```
- entity "Order"
1. PK id
* ATTR id : integer : PK
ATTR client: text
ATTR x : PK
ATTR id : date
ENTITY
prose line
ENTITY orders
**ATTR** total : decimal
ENTITY Client
ATTR id : integer : PK
REL Order → Client : N -> 1 : FK=client
REL Orders -> Client : 0..N -> one : FK=Client
REL A->B:N->1
REL broken
```"""


def parsed(spark, text):
    return dsl.parse_models(spark.createDataFrame([(text,)], "t string"), "t").first()


def test_parser(spark):
    row = parsed(spark, TEXT)
    order, client = row.candidate.entities
    assert (order.name, order.pk, [a.name for a in order.attrs]) == ("Order", ["id"], ["id", "client", "x", "total"])
    assert [a.is_fk for a in order.attrs] == [False, True, False, False] and not order.attrs[2].is_pk
    assert (client.name, client.pk) == ("Client", ["id"])
    assert [(r.frm, r.to, r.cf, r.fk) for r in row.candidate.relationships] == [("Order", "Client", "N", "client"), ("A", "B", "N", "")]
    assert row.parse.rejected_lines == ["Here is my answer:", "ENTITY", "prose line", "REL broken"] and not row.parse.parse_failure
    assert parsed(spark, None).parse.parse_failure and parsed(spark, "").parse.lines_total == 0


def test_render_is_inverse(spark):
    first = dsl.parse_models(spark.createDataFrame([(TEXT,)], "t string"), "t").select(F.col("candidate").alias("c"))
    again = dsl.parse_models(first.select("c", dsl.render_model(F.col("c")).alias("t")), "t").first()
    assert again.candidate == again.c


REFS = [("d", 1, "Order", ["Sale"], ["id"], [("id", "Identifier"), ("total", "Amount"), ("client", "ForeignKey")]), ("d", 2, "Client", [], ["id"], [("id", "Identifier"), ("name", "Name")])]
REF_SCHEMA = "dataset string, entity_ref long, name string, aliases array<string>, primary_key array<string>, attributes array<struct<name: string, semantic_type: string>>"


def test_identity_alias_and_faults(spark):
    refs = scoring.references(spark.createDataFrame(REFS, REF_SCHEMA))
    links = spark.createDataFrame([("d", [("client", "order", "1:N", ["client"])])], "dataset string, links array<struct<parent: string, child: string, klass: string, fk_cols: array<string>>>")
    perfect = "ENTITY Sales\nPK id\nATTR id: t: PK\nATTR total: t\nATTR client: t: FK\nENTITY Client\nPK id\nATTR id: t: PK\nATTR name: t\nREL Sale -> Client : N -> 1 : FK=client"
    faulty = "ENTITY Sales\nPK id\nATTR id: t: PK\nENTITY Ghost\nPK g\nATTR g: t\nREL Ghost -> Client : N -> 1"
    df = dsl.parse_models(spark.createDataFrame([("a", "d", perfect), ("b", "d", faulty), ("c", "d", "")], "run_id string, dataset string, text string"), "text")
    rows = {r.run_id: r.scores for r in scoring.score_models(df, refs).collect()}
    assert all(rows["a"][k].f1 == 1.0 for k in ("entities", "keys", "attributes"))
    assert (rows["b"].entities.tp, rows["b"].entities.fp, rows["b"].entities.fn) == (1, 1, 1)
    assert (rows["c"].entities.tp, rows["c"].entities.fn, rows["c"].attributes.f1) == (0, 2, 0.0)
    rels = {r.run_id: r for r in scoring.score_relationships(df, refs, links).collect()}
    assert rels["a"].relationships.f1 == 1.0 and rels["a"].relaxed_recall == 1.0 and rels["b"].relationships.fp == 1


def test_digests_of_synthetic_tables(spark):
    made = {r.name: r.sha256 for r in synth.build_all(spark).collect()}
    assert made == {"airlines.csv": "cc98710193e631dead85d6d6fab3ddb3d9b843ab52dd872ac62d02b892242a01", "manufacturing.csv": "bf3c2c373e95ad3ea22a4a011909a75a901f341677a3dfb5152b89b288b63692"}


def test_synthesized_models_have_the_published_sizes(spark):
    for made, columns, entities, rels in ((synth.manufacturing(spark), synth.MANUFACTURING, 7, 6), (synth.airlines(spark), synth.AIRLINES, 11, 10)):
        names = [f"c{i + 1}" for i in range(len(columns))]
        text = dependencies.synthesize(made.select(*columns).toDF(*names), names).first().text
        model = parsed(spark, text)
        assert (len(model.candidate.entities), len(model.candidate.relationships), model.parse.lines_rejected) == (entities, rels, 0)


def test_dependencies_with_nulls(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, "b", "x"), (2, "b", None)], "x int, y string, z string")
    found = {tuple(r) for r in profile.single_fds(df, ["x", "y", "z"]).collect()}
    assert found == {("x", "y"), ("y", "x")}
    assert profile.single_fds(df.limit(0), ["x", "y"]).count() == 0
    assert profile.minimal_unique_combination(df, ["x", "z"]) == ["x", "z"]


def test_cover_meets_requirements(spark):
    rows = [(g, f"v{(g * 7 + i) % 5}", f"w{g % 3}") for g in range(12) for i in range(g % 4 + 1)]
    df = spark.createDataFrame(rows, "g int, a string, b string")
    sample = sampling.sample_rows(df, ["g"], sampling.greedy_cover(df, ["g"], ["a", "b"]))
    for r in sampling.representativeness(df, sample, ["a", "b"]).collect():
        assert r.distinct_full == r.distinct_in_sample and r.frequent_full == r.frequent_in_sample


def test_wilcoxon_and_friedman(spark):
    pairs = spark.createDataFrame([("g", 1.0, 0.0), ("g", 3.0, 1.0), ("g", 0.0, 2.0), ("g", 5.0, 5.0), ("h", 1.0, 1.0)], "k string, l double, r double")
    rows = {r.k: r for r in stats.wilcoxon(pairs, ["k"], "l", "r").collect()}
    assert (rows["g"].n, rows["g"].w_plus, rows["g"].w_minus, rows["g"].median_delta) == (3, 3.5, 2.5, 0.5) and rows["h"].p == 1.0
    blocks = spark.createDataFrame([("g", b, t, float(t + b)) for b in range(4) for t in range(3)], "k string, b int, t int, v double")
    assert stats.friedman(blocks, ["k"], ["b"], "t", "v").first().q == pytest.approx(8.0)


def test_design_and_prompts(spark):
    assert design.conditions(spark).count() == 24
    assert design.run_matrix(spark, ["a", "b"], ["x", "y"], [0.0, 0.2, 0.5], 3).select("run_id").distinct().count() == 864
    with pytest.raises(Exception, match="placeholder"):
        spark.range(1).select(design.render(F.lit("{{OTHER}}"), F.lit(""), F.lit(""))).collect()


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x,\ny"\n2,"say ""hi"""\n')
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "t.csv"), ["a", "b"]).collect()] == [("1", "x,\ny"), ("2", 'say "hi"')]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r1.json").write_text('{"run_id": "r1", "dataset": "d", "generated_at": "2025-01-01T10:00:00", "response_text": "ENTITY Order\\nPK id"}')
    (tmp_path / "in" / "bad.json").write_text("{nope")
    assert sum(r.corrupt is not None for r in tables.read_records(spark, str(tmp_path / "in"), tables.RAW).select("run_id", "corrupt").collect()) == 1
    assert tables.read_records(spark, str(tmp_path / "in"), tables.RAW, "r1*").count() == 1
    (tmp_path / "in" / "bad.json").unlink()
    refs = scoring.references(spark.createDataFrame(REFS, REF_SCHEMA)).cache()
    stream = runs.scored_stream(runs.read_arriving(spark, str(tmp_path / "in"), tables.RAW), refs)
    runs.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first().scores.entities.tp == 1
    (tmp_path / "env").write_text("# c\nA=1=2\nB\n")
    assert tables.read_settings(str(tmp_path / "env")) == {"A": "1=2"}
    cube = spark.createDataFrame([("m", "d", 1.0), ("m", "e", 2.0)], "model string, dataset string, f1 double")
    assert tables.nested_json(cube, ["model", "dataset"], ["f1"]).first().json == '{"d":{"f1":1.0},"e":{"f1":2.0}}'


def test_canon_of_all_names_equals_unicodedata(spark, tmp_path):
    import re
    import unicodedata

    from sondage.functions.text import IRREGULAR
    from sondage.plans import catalog

    def canonical(name):
        parts = [t.lower() for t in re.split(r"[\s_\-./]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", unicodedata.normalize("NFKC", name))) if t]
        if parts:
            t = parts[-1]
            parts[-1] = IRREGULAR[t] if t in IRREGULAR else t[:-3] + "y" if t.endswith("ies") and len(t) > 4 else t[:-2] if t.endswith("ses") and len(t) > 4 else t[:-1] if t.endswith("s") and not t.endswith("ss") and len(t) > 3 else t
        return re.sub("[^a-z0-9]", "", "".join(parts))

    names = ["LineItems", "Ｃｕｓｔｏｍｅｒｓ", "ﬁle entries", "Größe", "Straßen", "Café_Orders", "Cafe\u0301s", "Nº 4", "Order\u00a0Lines", "顧客", "№ Ⅳ", "Ａ１"]
    rows = [((([(n,)],)),) for n in [*names, names[1]]]
    spark.createDataFrame(rows, "candidate struct<entities: array<struct<name: string>>>").write.parquet(str(tmp_path / "parsed_records.parquet"))
    found = [tuple(r) for r in catalog.QUERIES["canon_all_names"](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted((n, canonical(n)) for n in names)
