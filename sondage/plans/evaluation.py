"""Queries of sources and sinks, audit, prompts, campaigns, tests and scoring with alternate keys, each with its SQL."""

from __future__ import annotations

import json
import uuid
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import audit, dependencies, design, dsl, factorial, integrity, profile, sampling, scoring, stats, synth
from sondage.plans import catalog
from sondage.session import checkpoint, scratch, spread, table
from sondage.sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# --- sources and sinks ------------------------------------------------------------------------------------------------

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@query("csv_round_trip", f"SELECT {', '.join(f'{c}::VARCHAR AS {c}' for c in CUSTOMER)} FROM customer")
def csv_round_trip(s: SparkSession, sf: str) -> DataFrame:
    """SRC1-SRC3, SNK2: a table written as sorted CSV and read again as text."""
    folder = f"{scratch(s)}/csv-{uuid.uuid4().hex}"
    tables.write_csv(table(s, sf, "customer").select(*CUSTOMER, F.col("c_custkey").alias("place")), folder, "place")
    return tables.read_csv(s, folder, CUSTOMER)


@query("record_round_trip", "SELECT run_id, provider, dataset, temperature, replicate, metrics.keys.pk_only.tp AS pk_tp, metrics.entities.f1 AS entities_f1, provider = (SELECT min(provider) FROM metrics_records WHERE metrics IS NOT NULL) AS by_glob FROM metrics_records WHERE metrics IS NOT NULL AND provider IS NOT NULL")
def record_round_trip(s: SparkSession, sf: str) -> DataFrame:
    """SRC4-SRC8, SNK3, SNK4: records written as JSON by provider, and read again, one provider by its path too."""
    folder = f"{scratch(s)}/records-{uuid.uuid4().hex}"
    records = table(s, sf, "metrics_records").where("metrics is not null and provider is not null")
    tables.write_records(records.select("run_id", "provider", F.col("provider").alias("part"), "dataset", "temperature", "replicate", "metrics"), folder, ["part"])
    least = records.agg(F.min("provider")).first()[0]
    found = s.read.schema(tables.METRICS).json(folder)
    one = s.read.schema(tables.METRICS).json(f"{folder}/part={least}").select("run_id").distinct().withColumn("by_glob", F.lit(True)) if least is not None else found.select("run_id").limit(0).withColumn("by_glob", F.lit(True))
    return found.join(one, "run_id", "left").select("run_id", "provider", "dataset", "temperature", "replicate", F.col("metrics.keys.pk_only.tp").alias("pk_tp"), F.col("metrics.entities.f1").alias("entities_f1"), F.coalesce("by_glob", F.lit(False)).alias("by_glob"))


@query("prompt_round_trip", "SELECT prompt_file AS name, sha256(prompt_text) AS digest FROM prompts")
def prompt_round_trip(s: SparkSession, sf: str) -> DataFrame:
    """SRC9, SNK6: rendered prompts, a file each, and read again whole."""
    folder = f"{scratch(s)}/prompts-{uuid.uuid4().hex}"
    tables.write_prompts(table(s, sf, "prompts").select(F.col("prompt_file").alias("name"), F.col("prompt_text").alias("text")), folder)
    return tables.read_prompts(s, folder).select("name", F.sha2("text", 256).alias("digest"))


@query("nested_tokens", "SELECT provider, json FROM (SELECT provider, concat('{', string_agg(concat('\"', dataset, '\":{\"runs\":', runs, '}'), ',' ORDER BY dataset), '}') AS json FROM (SELECT provider, dataset, count(*) AS runs FROM raw_records GROUP BY provider, dataset) GROUP BY provider)")
def nested_tokens(s: SparkSession, sf: str) -> DataFrame:
    """SNK5: an aggregate as nested JSON."""
    runs = table(s, sf, "raw_records").groupBy("provider", "dataset").agg(F.count("*").alias("runs"))
    return tables.nested_json(runs, ["provider", "dataset"], ["runs"])


@query("record_states", "SELECT * FROM (VALUES ('a.json', 'valid'), ('b.json', 'corrupt'), ('c.json', 'missing')) AS t(name, status)")
def record_states(s: SparkSession, sf: str) -> DataFrame:
    """SNK9: record files that are valid, corrupt or missing."""
    folder = f"{scratch(s)}/states-{uuid.uuid4().hex}"
    for name, text in (("a.json", json.dumps({"run_id": "x", "provider": "p"})), ("b.json", '{"run_id": "x", ')):
        _put(s, f"{folder}/{name}", text)
    return tables.valid_records(s, folder, s.createDataFrame([("a.json",), ("b.json",), ("c.json",)], "name string"))


def _put(s: SparkSession, path: str, text: str) -> None:
    """A small file on any file system that Spark knows."""
    jvm, conf = s.sparkContext._jvm, s.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(conf).create(place, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


# --- scoring ----------------------------------------------------------------------------------------------------------

# The reference accepts each entity's second attribute as a key too and every attribute under a name with x_ before it. The
# candidate has all entities, by turns with the key, with the alternate key under its other name, and with a wrong key.
ALTERNATE = """SELECT dataset, count(*) AS entities_tp, count(*) FILTER (entity_ref % 3 != 2) AS pk_tp, count(*) FILTER (entity_ref % 3 = 2) AS pk_fp, count(*) FILTER (entity_ref % 3 = 2) AS pk_fn,
sum(len(list_filter(attributes, lambda a: coalesce(a.semantic_type = 'ForeignKey', false))))::BIGINT AS fk_tp, sum(len(list_filter(attributes, lambda a: NOT coalesce(a.semantic_type = 'ForeignKey', false))))::BIGINT AS attributes_tp,
0::BIGINT AS attributes_fp, 0::BIGINT AS attributes_fn FROM ref_entities GROUP BY dataset"""


@query("alternate_key_scores", ALTERNATE)
def alternate_key_scores(s: SparkSession, sf: str) -> DataFrame:
    """SC2, SC3, JN7-JN9: candidate keys and aliases of attributes in keys and attributes."""
    refs = table(s, sf, "ref_entities")
    second = F.coalesce(F.get(F.col("attributes"), F.lit(1)), F.get(F.col("attributes"), F.lit(0)))["name"]
    other = lambda name: F.concat(F.lit("x_"), name)
    also = F.map_from_entries(F.transform("attributes", lambda a: F.struct(a["name"].alias("key"), F.array(other(a["name"])).alias("value"))))
    reference = scoring.references(refs.withColumn("candidate_keys", F.array(F.array(second))).withColumn("attribute_aliases", also))
    turn = F.pmod("entity_ref", F.lit(3))
    pk = F.when(turn == 0, F.col("primary_key")).when(turn == 1, F.array(other(second))).otherwise(F.array(F.lit("wrong_column")))
    attrs = F.transform("attributes", lambda a, i: F.struct(F.when(i % 2 == 0, a["name"]).otherwise(other(a["name"])).alias("name"), F.lit(False).alias("is_pk"), F.coalesce(a["semantic_type"] == "ForeignKey", F.lit(False)).alias("is_fk")))
    entity = F.struct(F.coalesce(F.get("aliases", F.lit(0)), F.col("name")).alias("name"), pk.alias("pk"), attrs.alias("attrs"))
    made = refs.select("dataset", F.struct("entity_ref", entity.alias("e")).alias("x")).groupBy("dataset").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias("entities"))
    links = F.array().cast("array<struct<frm: string, to: string, cf: string, ct: string, fk: string, fk_cols: array<string>>>")
    runs = made.select("dataset", F.struct("entities", links.alias("relationships")).alias("candidate"))
    found = scoring.score_models(runs, reference)
    return found.select("dataset", F.col("scores.entities.tp").alias("entities_tp"), *[F.col(f"scores.pk_only.{c}").alias(f"pk_{c}") for c in ("tp", "fp", "fn")], F.col("scores.fk_only.tp").alias("fk_tp"), *[F.col(f"scores.attributes.{c}").alias(f"attributes_{c}") for c in ("tp", "fp", "fn")])


@query("reference_from_json", "SELECT name, len(attributes) AS attributes, primary_key[1] AS key, 'x_' || primary_key[1] AS also, 1 AS links, '1:N' AS klass FROM ref_entities WHERE dataset = 'clinic'")
def reference_from_json(s: SparkSession, sf: str) -> DataFrame:
    """SC2, SC3: a reference model and its aliases from JSON documents; another dataset's aliases are none."""
    rows = table(s, sf, "ref_entities").where("dataset = 'clinic'").orderBy("entity_ref").collect()
    document = {
        "entities": [{"name": r["name"], "primaryKey": list(r["primary_key"]), "candidateKeys": [], "attributes": [{"name": a["name"], "semanticType": a["semantic_type"]} for a in r["attributes"]]} for r in rows],
        "relationships": [{"source": rows[0]["name"], "target": rows[1]["name"], "cardinality": {"source": "1", "target": "0..N"}, "foreignKey": {"attributes": list(rows[0]["primary_key"])}}] if len(rows) > 1 else [],
    }
    aliases = {"clinic": {"entities": {}, "attributes": {f"{r['name']}.{r['primary_key'][0]}": [f"x_{r['primary_key'][0]}"] for r in rows}}}
    folder = f"{scratch(s)}/reference-{uuid.uuid4().hex}"
    _put(s, f"{folder}/model.json", json.dumps(document))
    _put(s, f"{folder}/aliases.json", json.dumps(aliases))
    entities, links = tables.read_reference(s, f"{folder}/model.json", "clinic", f"{folder}/aliases.json")
    also = F.try_element_at(F.col("attribute_aliases"), F.get("primary_key", F.lit(0)))
    return entities.crossJoin(F.broadcast(links.select("links"))).select("name", F.size("attributes").cast("bigint").alias("attributes"), F.get("primary_key", F.lit(0)).alias("key"), F.get(also, F.lit(0)).alias("also"), F.size("links").alias("links"), F.get("links", F.lit(0))["klass"].alias("klass"))


PARTS = ("entities", "relationships", "keys", "attributes")


@query("evaluated_models", "SELECT run_id, " + ", ".join(f"metrics.{d}.{c} AS {d}_{c}" for d in PARTS for c in ("tp", "fp", "fn", "precision", "recall", "f1")) + " FROM metrics_records WHERE metrics IS NOT NULL AND run_id IN (SELECT run_id FROM parsed_records WHERE dataset IN (SELECT dataset FROM ref_entities))")
def evaluated_models(s: SparkSession, sf: str) -> DataFrame:
    """SC8, SC10, PRJ3: the four blocks of scores in one call, as the metrics records have them."""
    wanted = table(s, sf, "metrics_records").where("metrics is not null").select("run_id")
    refs = table(s, sf, "ref_entities")
    runs = spread(table(s, sf, "parsed_records").select("run_id", "parsed_id", "dataset", "candidate"))
    found = scoring.evaluate(runs, scoring.references(refs), catalog.links_of(refs)).groupBy("run_id").agg(F.min_by("metrics", "parsed_id").alias("metrics"))
    return found.join(wanted, "run_id", "left_semi").select("run_id", *[F.col(f"metrics.{d}.{c}").alias(f"{d}_{c}") for d in PARTS for c in ("tp", "fp", "fn", "precision", "recall", "f1")])


@query(
    "parsed_details",
    """SELECT run_id, min(concat(array_to_string(list_transform(candidate.entities, lambda e: array_to_string(list_transform(e.attrs, lambda a: concat(a.name, CASE WHEN a.is_pk THEN '!' ELSE '' END, CASE WHEN a.is_fk THEN '^' ELSE '' END)), ',')), ';'))) AS attributes,
    min(array_to_string(list_transform(candidate.relationships, lambda r: array_to_string(r.fk_cols, ',')), ';')) AS fk_cols, min(array_to_string(parse.rejected_lines, chr(10))) AS rejected_lines
    FROM parsed_records WHERE run_id IN (SELECT run_id FROM raw_records) GROUP BY run_id""",
)
def parsed_details(s: SparkSession, sf: str) -> DataFrame:
    """SF10, JN12, AG25: names and flags of attributes, foreign-key columns and rejected lines."""
    m = dsl.parse_models(spread(table(s, sf, "raw_records").select("run_id", "raw_id", "response_text")), "response_text")
    attribute = lambda a: F.concat(a["name"], F.when(a["is_pk"], "!").otherwise(""), F.when(a["is_fk"], "^").otherwise(""))
    found = m.select(
        "run_id", "raw_id", F.array_join(F.transform("candidate.entities", lambda e: F.array_join(F.transform(e["attrs"], attribute), ",")), ";").alias("attributes"),
        F.array_join(F.transform("candidate.relationships", lambda r: F.array_join(r["fk_cols"], ",")), ";").alias("fk_cols"), F.array_join("parse.rejected_lines", "\n").alias("rejected_lines"),
    )
    kept = ["attributes", "fk_cols", "rejected_lines"]
    first = found.groupBy("run_id").agg(F.min_by(F.struct(*kept), "raw_id").alias("m")).select("run_id", *[f"m.{c}" for c in kept])
    return first.join(table(s, sf, "parsed_records").select("run_id").distinct(), "run_id", "left_semi")


@query("rendered_texts", "SELECT parsed_id, concat_ws(chr(10), array_to_string(nullif(list_transform(candidate.entities, lambda e: concat_ws(chr(10), 'ENTITY ' || e.name, CASE WHEN len(e.pk) > 0 THEN 'PK ' || array_to_string(e.pk, ', ') END, array_to_string(nullif(list_transform(e.attrs, lambda a: concat('ATTR ', a.name, ': text', CASE WHEN a.is_pk THEN ' : PK' ELSE '' END, CASE WHEN a.is_fk THEN ' : FK' ELSE '' END)), []), chr(10)))), []), chr(10)), array_to_string(nullif(list_transform(candidate.relationships, lambda r: concat('REL ', r.frm, ' -> ', r.\"to\", ' : ', r.cf, ' -> ', r.ct, CASE WHEN r.fk != '' THEN ' : FK=' || r.fk ELSE '' END)), []), chr(10))) AS text FROM parsed_records WHERE candidate IS NOT NULL")
def rendered_texts(s: SparkSession, sf: str) -> DataFrame:
    """SC11: models rendered in the line language."""
    return table(s, sf, "parsed_records").where("candidate is not null").select("parsed_id", dsl.render_model(F.col("candidate")).alias("text"))


# --- audit ------------------------------------------------------------------------------------------------------------

SALES = "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, c_custkey, c_name, c_nationkey, c_mktsegment, n_nationkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
SALES_MODEL = audit.Model(
    [
        audit.Entity("Order", ("key", "customer", "status"), ("key",), (), ({"key": "o_orderkey", "customer": "o_custkey", "status": "o_orderstatus"},)),
        audit.Entity("Customer", ("key", "name", "segment"), ("key",), (("name",),), ({"key": "c_custkey", "name": "c_name", "segment": "c_mktsegment"}, {"key": "o_custkey", "name": "c_name", "segment": "c_mktsegment"})),
        audit.Entity("Nation", ("key", "name", "region"), ("key",), (), ({"key": "n_nationkey", "name": "n_name"},)),
        audit.Entity("Segment", ("name", "status"), ("name",), (), ({"name": "c_mktsegment", "status": "o_orderstatus"},)),
        audit.Entity("Warehouse", ("key",), ("key",)),
    ],
    [audit.Reference("places", "Order", ("customer",), "Customer", ("key",)), audit.Reference("lives", "Customer", ("key",), "Nation", ("key",))],
)


def sales(s: SparkSession, sf: str) -> DataFrame:
    o, c, n = table(s, sf, "orders"), table(s, sf, "customer"), table(s, sf, "nation")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return joined.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "c_custkey", "c_name", "c_nationkey", "c_mktsegment", "n_nationkey", "n_name")


AUDIT_COLUMNS = sorted({c for e in SALES_MODEL.entities for p in e.projections for c in p.values()})
AUDIT = (
    catalog.fd_sql(SALES, AUDIT_COLUMNS).replace("WITH src", "WITH RECURSIVE src", 1)
    + ", wanted(lhs, rhs) AS (VALUES "
    + ", ".join(map(str, sorted(SALES_MODEL.expected())))
    + """), paths AS (SELECT lhs, rhs FROM wanted UNION SELECT p.lhs, w.rhs FROM paths p JOIN wanted w ON p.rhs = w.lhs), inside AS ("""
    + " UNION ALL ".join(f"SELECT '{x}' AS lhs, '{y}' AS rhs FROM src HAVING bool_and(contains({x}::VARCHAR, {y}::VARCHAR) AND {y}::VARCHAR != '')" for x in AUDIT_COLUMNS for y in AUDIT_COLUMNS if x != y)
    + """), customers AS (SELECT DISTINCT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM src UNION SELECT DISTINCT o_custkey, c_name, c_mktsegment FROM src), found("check", subject, detail, bad) AS (
    SELECT 'columns exist', unnest(['Order 0', 'Customer 0', 'Customer 1', 'Nation 0', 'Segment 0']), 0, 'FAIL'
    UNION ALL SELECT 'attributes mapped', unnest(['Order 0', 'Customer 0', 'Customer 1', 'Segment 0']), 0, 'FAIL' UNION ALL SELECT 'attributes mapped', 'Nation 0', 1, 'FAIL'
    UNION ALL SELECT 'key determines', 'Order (key)', (SELECT count(*) FROM (SELECT o_orderkey FROM src GROUP BY o_orderkey HAVING count(DISTINCT (o_custkey, o_orderstatus)) > 1)), 'FAIL'
    UNION ALL SELECT 'key determines', 'Customer (key)', (SELECT count(*) FROM (SELECT key FROM customers GROUP BY key HAVING count(DISTINCT (name, segment)) > 1)), 'FAIL'
    UNION ALL SELECT 'key determines', 'Customer (name)', (SELECT count(*) FROM (SELECT name FROM customers GROUP BY name HAVING count(DISTINCT (key, segment)) > 1)), 'FAIL'
    UNION ALL SELECT 'key determines', 'Nation (key)', (SELECT count(*) FROM (SELECT n_nationkey FROM src GROUP BY n_nationkey HAVING count(DISTINCT n_name) > 1)), 'FAIL'
    UNION ALL SELECT 'key determines', 'Segment (name)', (SELECT count(*) FROM (SELECT c_mktsegment FROM src GROUP BY c_mktsegment HAVING count(DISTINCT o_orderstatus) > 1)), 'FAIL'
    UNION ALL SELECT 'reference', 'places: Order -> Customer', (SELECT count(DISTINCT o_custkey) FROM src WHERE o_custkey NOT IN (SELECT key FROM customers)), 'FAIL'
    UNION ALL SELECT 'reference', 'lives: Customer -> Nation', (SELECT count(DISTINCT key) FROM customers WHERE key NOT IN (SELECT n_nationkey FROM src)), 'FAIL'),
    instances(subject, a, n) AS (SELECT 'Order (customer)', count(DISTINCT o_custkey), count(DISTINCT (o_orderkey, o_custkey, o_orderstatus)) FROM src UNION ALL SELECT 'Order (status)', count(DISTINCT o_orderstatus), count(DISTINCT (o_orderkey, o_custkey, o_orderstatus)) FROM src
    UNION ALL SELECT 'Order (customer, status)', count(DISTINCT (o_custkey, o_orderstatus)), count(DISTINCT (o_orderkey, o_custkey, o_orderstatus)) FROM src
    UNION ALL SELECT 'Customer (segment)', count(DISTINCT segment), count(*) FROM customers UNION ALL SELECT 'Nation (name)', count(DISTINCT n_name), count(DISTINCT (n_nationkey, n_name)) FROM src
    UNION ALL SELECT 'Segment (status)', count(DISTINCT o_orderstatus), count(DISTINCT (c_mktsegment, o_orderstatus)) FROM src)
    SELECT "check", subject, CASE WHEN detail = 0 THEN 'OK' ELSE bad END AS status, detail::BIGINT AS detail FROM found
    UNION ALL SELECT 'bound', unnest(['Order', 'Nation', 'Segment']), 'OK', 1 UNION ALL SELECT 'bound', 'Customer', 'OK', 2 UNION ALL SELECT 'bound', 'Warehouse', 'FAIL', 0
    UNION ALL SELECT 'accidental key', subject, CASE WHEN contains(subject, ',') THEN 'WARN' ELSE 'FAIL' END, n FROM instances WHERE a = n
    UNION ALL SELECT 'dependency artifact', concat(lhs, ' -> ', rhs), 'WARN', 1 FROM fds WHERE (lhs, rhs) NOT IN (SELECT (lhs, rhs) FROM paths) AND (lhs, rhs) NOT IN (SELECT (lhs, rhs) FROM inside)"""
)
query("audit_sales", AUDIT)(lambda s, sf: audit.audit(checkpoint(sales(s, sf)), SALES_MODEL))

# --- prompts and campaigns --------------------------------------------------------------------------------------------

BASE = "You get a table.\n\nOUTPUT FORMAT\nENTITY <Name>\n\n{{DATA_BLOCK}}\n"
HEADS = {"meaningful": "c", "none": "'c' || i", "cryptic": "'C_' || upper(left(sha256(c), 6))"}


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_filled(text: str, value: str) -> str:
    before, _, after = text.partition("{}")
    return f"{_sql_text(before)} || {value} || {_sql_text(after)}"


RENDERED = f"""WITH refs AS (SELECT dataset, list(DISTINCT a.name ORDER BY a.name) AS cols FROM (SELECT dataset, unnest(attributes) AS a FROM ref_entities) GROUP BY dataset),
named AS (SELECT dataset, cols, {", ".join(f"list_transform(cols, lambda c, i: {e}) AS h_{m}" for m, e in HEADS.items())} FROM refs),
x AS (SELECT p.prompt_file, p.domain, p.dictionary, p.rules, p.dataset, cols, CASE p.headers WHEN 'meaningful' THEN h_meaningful WHEN 'none' THEN h_none ELSE h_cryptic END AS h FROM prompts p JOIN named USING (dataset))
SELECT prompt_file AS name, 'You get a table.' || chr(10) || chr(10) || CASE WHEN domain THEN {_sql_filled(design.DOMAIN_TEXT, "dataset")} ELSE '' END
|| CASE WHEN dictionary THEN {_sql_filled(design.DICTIONARY_TEXT, "array_to_string(list_transform(cols, lambda c, i: concat('- ', h[i], ': about ', c)), chr(10))")} ELSE '' END
|| CASE WHEN rules THEN {_sql_filled(design.RULES_TEXT, "'- Keys are never empty.' || chr(10) || '- Dates are in UTC.'")} ELSE '' END
|| 'OUTPUT FORMAT' || chr(10) || 'ENTITY <Name>' || chr(10) || chr(10) || {_sql_filled(design.DATA_NOTE, "'2'")} || array_to_string(h, ',') || chr(10) || array_to_string(cols, '-1,') || '-1' || chr(10) || array_to_string(cols, '-2,') || '-2' || chr(10) AS text FROM x"""


@query("knowledge_prompts", RENDERED)
def knowledge_prompts(s: SparkSession, sf: str) -> DataFrame:
    """SF15-SF18: prompts of all conditions with their knowledge and data blocks."""
    columns = table(s, sf, "ref_entities").select("dataset", F.explode("attributes").alias("a")).groupBy("dataset").agg(F.array_sort(F.collect_set("a.name")).alias("cols"))
    p = table(s, sf, "prompts").join(F.broadcast(columns), "dataset")
    entries = F.transform("cols", lambda c: F.struct(c.alias("k"), F.concat(F.lit("about "), c).alias("v")))
    rows = F.transform(F.array(F.lit("-1"), F.lit("-2")), lambda n: F.array_join(F.transform("cols", lambda c: F.concat(c, n)), ","))
    by_mode = lambda make: F.when(F.col("headers") == "meaningful", make("meaningful")).when(F.col("headers") == "none", make("none")).otherwise(make("cryptic"))
    blocks = design.knowledge_blocks(F.col("dataset"), by_mode(lambda m: design.dictionary_block(entries, m)), F.array(F.lit("Keys are never empty."), F.lit("Dates are in UTC.")), tuple(map(F.col, ("domain", "dictionary", "rules"))))
    return p.select(F.col("prompt_file").alias("name"), design.render(F.lit(BASE), blocks, by_mode(lambda m: design.data_block(F.col("cols"), rows, m))).alias("text"))


query("pilot_runs", catalog.MATRIX + " SELECT run_id, seed FROM x WHERE run_id LIKE '%__k111__hm__t00__r1'")(lambda s, sf: design.pilot(catalog.matrix(s)).select("run_id", "seed"))
query("only_runs", catalog.MATRIX + " SELECT run_id, seed FROM x WHERE run_id LIKE 'library__%__k010__hc__t02__r3'")(lambda s, sf: design.only_cell(catalog.matrix(s), "library", "k010__hc", 0.2, 3).select("run_id", "seed"))


def _answer(batches):
    """A model called by the partition, in place of a network service."""
    for frame in batches:
        frame["response_text"] = ["ENTITY Thing\nPK id" for _ in frame["prompt_text"]]
        frame["input_tokens"] = [len(text) // 4 for text in frame["prompt_text"]]
        yield frame[["run_id", "prompt_file", "prompt_text", "response_text", "input_tokens"]]


@query("campaign_records", catalog.MATRIX.replace("AS run_id, (CASE", "AS run_id, d, cond_id, (CASE", 1) + """, asked AS (SELECT dataset, cond_id, arg_min(prompt_file, prompt_file) AS prompt_file, arg_min(prompt_text, prompt_file) AS prompt_text FROM prompts GROUP BY dataset, cond_id)
    SELECT run_id, prompt_file, sha256(prompt_text) AS prompt_sha256, 'ENTITY Thing' || chr(10) || 'PK id' AS response_text, length(prompt_text) // 4 AS input_tokens FROM x JOIN asked ON x.d = asked.dataset AND x.cond_id = asked.cond_id WHERE run_id NOT IN (SELECT run_id FROM raw_records)""")
def campaign_records(s: SparkSession, sf: str) -> DataFrame:
    """CP1, CP6, SRC14: the runs without a record, answered by a model plugged in."""
    schema = "run_id string, prompt_file string, prompt_text string, response_text string, input_tokens bigint"
    made = design.campaign(catalog.matrix(s), table(s, sf, "raw_records"), table(s, sf, "prompts"), lambda asked: asked.select("run_id", "prompt_file", "prompt_text").mapInPandas(_answer, schema))
    return made.select("run_id", "prompt_file", "prompt_sha256", "response_text", "input_tokens")


query("run_counts", catalog.MATRIX + ", r AS (SELECT run_id, bool_and(response_text IS NULL) AS failed FROM raw_records GROUP BY run_id) SELECT count(*) FILTER (failed = false) AS done, count(*) FILTER (failed) AS failed, count(*) FILTER (failed IS NULL) AS pending, count(*) AS total FROM x LEFT JOIN r USING (run_id)")(
    lambda s, sf: factorial.run_counters(catalog.matrix(s), table(s, sf, "raw_records"), F.col("response_text").isNull())
)

# --- aggregates, samples, statistics ----------------------------------------------------------------------------------

query("model_names", "SELECT provider, CASE provider WHEN 'ardent' THEN 'ardent-1' ELSE provider END AS model, count(*) AS n FROM metrics_records GROUP BY provider")(
    lambda s, sf: factorial.with_model(table(s, sf, "metrics_records"), {"ardent": "ardent-1"}).groupBy("provider", "model").agg(F.count("*").alias("n"))
)
query("cell_counts", f"SELECT count(*) AS cells, sum(n)::BIGINT AS runs FROM (SELECT count(*) AS n FROM metrics_records GROUP BY {', '.join(catalog.CELL)})")(lambda s, sf: factorial.cell_count(table(s, sf, "metrics_records"), catalog.CELL))
query("replicate_lists", f"SELECT {', '.join(catalog.CELL)}, dim, array_to_string(list(round(f1 * 10000)::BIGINT ORDER BY replicate, f1), ',') AS f1s, count(*) AS n FROM {catalog.LONG} WHERE f1 IS NOT NULL GROUP BY {', '.join(catalog.CELL)}, dim")(
    lambda s, sf: factorial.replicate_lists(table(s, sf, "metrics_records"), catalog.CELL).select(*catalog.CELL, "dim", F.array_join(F.transform("f1s", lambda x: F.round(x * 10000).cast("bigint")), ",").alias("f1s"), F.size("f1s").cast("bigint").alias("n"))
)
query("sorted_cube", f"SELECT provider, dataset, dim, count(*) AS n, row_number() OVER (ORDER BY provider, dataset, dim)::INT AS place FROM {catalog.LONG} GROUP BY provider, dataset, dim")(
    lambda s, sf: s.createDataFrame([(*r, i + 1) for i, r in enumerate(factorial.sorted_cube(factorial.long_scores(table(s, sf, "metrics_records"), ["provider", "dataset"]).groupBy("provider", "dataset", "dim").agg(F.count("*").alias("n")), ["provider", "dataset", "dim"]).collect())], "provider string, dataset string, dim string, n bigint, place int")
)
query("group_order", "SELECT user_id, count(*) AS rows, min(event_id) AS first_row FROM events GROUP BY user_id")(lambda s, sf: sampling.group_rows(table(s, sf, "events"), ["user_id"], "event_id"))

SAMPLED = "(SELECT * FROM orders WHERE o_custkey % 50 = 0)"
query(
    "sample_coverage",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS distinct_full, count(m) AS distinct_in_sample, count(*) FILTER (n >= 2) AS frequent_full, count(*) FILTER (n >= 2 AND m >= 2) AS frequent_in_sample, count(*) <= 50 AS is_target, round(100.0 * count(m) / count(*), 1) AS coverage_pct FROM (SELECT {c}, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY {c}) LEFT JOIN (SELECT {c}, count(*) AS m FROM {SAMPLED} WHERE {c} IS NOT NULL GROUP BY {c}) USING ({c})"
        for c in ("o_custkey", "o_orderstatus", "o_orderpriority")
    ),
)(lambda s, sf: sampling.representativeness(table(s, sf, "orders"), table(s, sf, "orders").where("o_custkey % 50 = 0"), ["o_custkey", "o_orderstatus", "o_orderpriority"]))
query("sample_size", f"SELECT (SELECT count(*) FROM orders) AS full_rows, (SELECT count(DISTINCT o_custkey) FROM orders) AS full_groups, (SELECT count(*) FROM {SAMPLED}) AS sample_rows, (SELECT count(DISTINCT o_custkey) FROM {SAMPLED}) AS sample_groups")(
    lambda s, sf: sampling.sample_size(table(s, sf, "orders"), table(s, sf, "orders").where("o_custkey % 50 = 0"), ["o_custkey"])
)
query("minimal_key_lineitem", "SELECT CASE WHEN " + " WHEN ".join(f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(c)} FROM lineitem)) = (SELECT count(*) FROM lineitem) THEN '{', '.join(c)}'" for n in (1, 2, 3) for c in combinations(catalog.LINE, n)) + f" ELSE '{', '.join(catalog.LINE)}' END AS key")(
    lambda s, sf: s.createDataFrame([(", ".join(profile.minimal_unique_combination(table(s, sf, "lineitem"), catalog.LINE)),)], "key string")
)
query("renamed_columns", "SELECT n_nationkey AS C_1, n_name AS C_2, n_regionkey AS C_3 FROM nation")(lambda s, sf: table(s, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").toDF("C_1", "C_2", "C_3"))
query("role_common_rows", "SELECT DISTINCT c_nationkey AS nation FROM customer UNION ALL SELECT DISTINCT s_nationkey FROM supplier")(lambda s, sf: _common(s, sf))


def _common(s: SparkSession, sf: str) -> DataFrame:
    """PRJ5, ST8: roles projected on the attributes that both have."""
    roles = audit.Entity("Place", ("nation", "label", "balance"), ("nation",), (), ({"nation": "c_nationkey", "label": "c_mktsegment"}, {"nation": "s_nationkey", "balance": "s_suppkey"}))
    return integrity.stack([integrity.projection(table(s, sf, t), {a: p[a] for a in roles.common}) for t, p in zip(("customer", "supplier"), roles.projections, strict=True)])


# The normal tail by Simpson's rule, as SQL has no error function.
TAIL = "1 - 2 * (SELECT sum(w * exp(-(z * i / 400) * (z * i / 400) / 2)) * z / 1200 / sqrt(2 * pi()) FROM (SELECT unnest(range(401)) AS i, unnest(list_transform(range(401), lambda k: CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)) AS w))"


# Subsets of the ranks 1..n by their sum, a rank at a time, and from them the exact p where it applies.
EXACT = """CASE WHEN n <= 50 AND n = pairs AND t = 0 THEN least(1.0, 2 * list_sum(list_reduce(list_concat([list_transform(range((n * (n + 1) / 2)::BIGINT + 1), lambda i: CASE WHEN i = 0 THEN 1.0 ELSE 0.0 END::DOUBLE)],
    list_transform(range(1, n::BIGINT + 1), lambda r: [r::DOUBLE])), lambda a, x: list_transform(range(len(a)), lambda i: a[i + 1] + CASE WHEN i >= x[1] THEN a[i - x[1]::BIGINT + 1] ELSE 0 END))[1:floor(w)::BIGINT + 1]) / 2 ** n) END"""


def wilcoxon_sql(pairs: str, by: str) -> str:
    """Pairs (by, d): counts, median, lesser rank sum, ties and z."""
    return f"""WITH d AS ({pairs}), k AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {by}, abs(d)) - 1) / 2 AS rank, count(*) OVER (PARTITION BY {by}, abs(d)) AS ties FROM d WHERE d != 0),
    s AS (SELECT {by}, count(*)::DOUBLE AS n, least(sum(CASE WHEN d > 0 THEN rank ELSE 0 END), sum(CASE WHEN d < 0 THEN rank ELSE 0 END)) AS w, sum(ties * ties - 1)::DOUBLE AS t FROM k GROUP BY {by}),
    m AS (SELECT {by}, count(*) AS pairs, round(median(d), 9) AS median_delta FROM d GROUP BY {by}), z AS (SELECT m.*, n, t, w, abs((w - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - t / 2) / 24)) AS z FROM m LEFT JOIN s USING ({by}))"""


MEANS = f"SELECT provider, dim, dataset, cond_id, round(avg(f1) FILTER (temperature = 0), 9) AS a, round(avg(f1) FILTER (temperature = 0.2), 9) AS b, round(avg(f1) FILTER (temperature = 0.5), 9) AS c FROM {catalog.LONG} GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL"
TEMPERATURE = (
    wilcoxon_sql(f"SELECT provider, round(a - c, 9) AS d FROM ({MEANS})", "provider")
    + f""", full_cells AS ({MEANS}), g AS (SELECT provider, count(*) AS cells, round(avg(a), 9) AS grand_mean_first, round(avg(c), 9) AS grand_mean_last FROM full_cells GROUP BY provider),
    l AS (SELECT provider, dim, dataset, cond_id, unnest(['a', 'b', 'c']) AS level, unnest([a, b, c]) AS f FROM full_cells),
    r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY provider, dim, dataset, cond_id, f) - 1) / 2 AS rank, count(*) OVER (PARTITION BY provider, dim, dataset, cond_id, f) AS ties FROM l WINDOW w AS (PARTITION BY provider, dim, dataset, cond_id ORDER BY f)),
    p AS (SELECT provider, level, sum(rank) AS total, count(*)::DOUBLE AS n, sum(ties * ties - 1)::DOUBLE AS t FROM r GROUP BY provider, level),
    q AS (SELECT provider, (12 / (max(n) * 12) * sum(total * total) - 12 * max(n)) / (1 - sum(t) / (max(n) * 24)) AS q FROM p GROUP BY provider)
    SELECT provider, cells, grand_mean_first, grand_mean_last, round(-median_delta, 9) + 0.0 AS median_delta, round(coalesce({EXACT}, {TAIL}, 1.0), 4) AS wilcoxon_p, round(q, 6) AS friedman_q, round(exp(-q / 2), 4) AS friedman_p FROM g JOIN z USING (provider) JOIN q USING (provider)"""
)


@query("temperature_tests", TEMPERATURE)
def temperature_tests(s: SparkSession, sf: str) -> DataFrame:
    """TS3, TS4, AG17, AG18: the effect of temperature per provider, over cells of dataset, condition and dimension."""
    found = stats.temperature_effect(catalog.scores(s, sf).where("f1 is not null"), ["provider"], ["dim", "dataset", "cond_id"])
    return found.select("provider", "cells", *[F.round(c, 9).alias(c) for c in ("grand_mean_first", "grand_mean_last")], (F.round("median_delta", 9) + 0.0).alias("median_delta"), F.round("wilcoxon_p", 4).alias("wilcoxon_p"), F.round("friedman_q", 6).alias("friedman_q"), F.round("friedman_p", 4).alias("friedman_p"))


@query("gap_tests", wilcoxon_sql(f"SELECT dataset, round(l - r, 9) AS d FROM ({catalog.GAPS}) WHERE l IS NOT NULL AND r IS NOT NULL", "dataset") + f" SELECT dataset, pairs, median_delta + 0.0 AS median_delta, round(coalesce({EXACT}, {TAIL}, 1.0), 4) AS p FROM z")
def gap_tests(s: SparkSession, sf: str) -> DataFrame:
    """TS1, TS2, AG17: median difference of two providers and its p, per dataset over all cells and dimensions."""
    cells = stats.model_cells(catalog.scores(s, sf), ["dataset", "dim", "cond_id", "temperature"], "ardent", "boreal").dropna(subset=["left_f1", "right_f1"])
    found = stats.wilcoxon(cells.withColumn("left_f1", F.round(F.col("left_f1") - F.col("right_f1"), 9)).withColumn("right_f1", F.lit(0.0)), ["dataset"], "left_f1", "right_f1")
    return found.select("dataset", "pairs", (F.round("median_delta", 9) + 0.0).alias("median_delta"), F.round("p", 4).alias("p"))


GAP_PAIRS = f"SELECT dataset, dim, round(l - r, 9) AS d FROM ({catalog.GAPS}) WHERE l IS NOT NULL AND r IS NOT NULL"


@query("model_gap_tests", wilcoxon_sql(GAP_PAIRS, "dataset, dim") + f" SELECT dataset, dim, pairs, coalesce(n, 0)::BIGINT AS n, median_delta + 0.0 AS median_delta, coalesce(w, 0.0) AS lesser_sum, round(coalesce({EXACT}, {TAIL}, 1.0), 4) AS p FROM z")
def model_gap_tests(s: SparkSession, sf: str) -> DataFrame:
    """TS1, TS2, AG17: the same per dataset and dimension, with the lesser rank sum."""
    cells = stats.model_cells(catalog.scores(s, sf), ["dataset", "dim", "cond_id", "temperature"], "ardent", "boreal").dropna(subset=["left_f1", "right_f1"])
    found = stats.wilcoxon(cells.withColumn("left_f1", F.round(F.col("left_f1") - F.col("right_f1"), 9)).withColumn("right_f1", F.lit(0.0)), ["dataset", "dim"], "left_f1", "right_f1")
    return found.select("dataset", "dim", "pairs", "n", (F.round("median_delta", 9) + 0.0).alias("median_delta"), F.least("w_plus", "w_minus").alias("lesser_sum"), F.round("p", 4).alias("p"))


FRIEDMAN = f"""WITH m AS (SELECT provider, dim, dataset, cond_id, temperature, round(avg(f1), 9) AS f FROM {catalog.LONG} WHERE f1 IS NOT NULL GROUP BY ALL), b AS (SELECT *, count(*) OVER (PARTITION BY provider, dim, dataset, cond_id) AS k FROM m),
    r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY provider, dim, dataset, cond_id, f) - 1) / 2 AS rank, count(*) OVER (PARTITION BY provider, dim, dataset, cond_id, f) AS ties FROM b WHERE k = 3 WINDOW w AS (PARTITION BY provider, dim, dataset, cond_id ORDER BY f)),
    t AS (SELECT provider, dim, temperature, sum(rank) AS total, count(*)::DOUBLE AS n, sum(ties * ties - 1)::DOUBLE AS t FROM r GROUP BY ALL),
    q AS (SELECT provider, dim, max(n)::BIGINT AS n, (12 / (max(n) * 12) * sum(total * total) - 12 * max(n)) / nullif(1 - sum(t) / (max(n) * 24), 0) AS q FROM t GROUP BY ALL) SELECT provider, dim, n, round(q, 6) AS q, round(exp(-q / 2), 6) AS p FROM q"""


@query("friedman_tests", FRIEDMAN)
def friedman_tests(s: SparkSession, sf: str) -> DataFrame:
    """TS3: three temperatures over cells of dataset and condition, per provider and dimension."""
    cells = catalog.scores(s, sf).where("f1 is not null").groupBy("provider", "dim", "dataset", "cond_id", "temperature").agg(F.round(F.avg("f1"), 9).alias("f"))
    found = stats.friedman(cells, ["provider", "dim"], ["dataset", "cond_id"], "temperature", "f")
    return found.select("provider", "dim", "n", F.round("q", 6).alias("q"), F.round("p", 6).alias("p"))


@query("baseline_runs")
def baseline_runs(s: SparkSession, sf: str) -> DataFrame:
    """PF17: the profiled models of both synthetic tables under all ways to write their headers, as records."""
    found = []
    for name, made in (("airlines", synth.airlines(s)), ("manufacturing", synth.manufacturing(s))):
        made = made.drop("row_idx")
        texts = dependencies.synthesize(made, made.columns, ("meaningful", "cryptic", "none"))
        found.append(texts.withColumn("dataset", F.lit(name)))
    tag = F.substring("headers", 1, 1)
    whole = integrity.stack(found).withColumn("cond_id", F.concat(F.lit("k000__h"), tag))
    return whole.select(F.concat_ws("__", "dataset", F.lit("baseline"), "cond_id", F.lit("t00"), F.lit("r1")).alias("run_id"), "dataset", "cond_id", "headers", F.col("text").alias("response_text"), F.lit("deterministic").alias("finish_reason"))
