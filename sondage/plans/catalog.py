"""Queries of the profiling, scoring and evaluation operators over the given tables, each with its SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions.text import canon, entity_name, header
from sondage.operators import dependencies, design, dsl, factorial, integrity, profile, sampling, scoring, stats, synth
from sondage.session import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# --- dependencies -----------------------------------------------------------------------------------------------------

NATION_REGION = "SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"


def nation_region(s: SparkSession, sf: str) -> DataFrame:
    nation, region = table(s, sf, "nation"), table(s, sf, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "n_regionkey", "r_name")


def fd_sql(source: str, columns: list[str]) -> str:
    """Every pair tested by counting distinct tuples; nulls are values."""
    tests = [f"SELECT '{x}' AS lhs, '{y}' AS rhs FROM src HAVING count(DISTINCT struct_pack(a := {x})) = count(DISTINCT struct_pack(a := {x}, b := {y}))" for x in columns for y in columns if x != y]
    return f"WITH src AS ({source}), fds AS ({' UNION ALL '.join(tests)})"


FD_TABLES = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"],
}
for _table, _columns in FD_TABLES.items():
    query(f"fd_single_{_table}", fd_sql(f"SELECT * FROM {_table}", _columns) + " SELECT lhs, rhs FROM fds")(lambda s, sf, t=_table, c=_columns: profile.single_fds(table(s, sf, t), c))

NR = ["n_nationkey", "n_name", "n_regionkey", "r_name"]
NR_FDS = fd_sql(NATION_REGION, NR)


def nr_edges(s: SparkSession, sf: str) -> DataFrame:
    return profile.single_fds(nation_region(s, sf), NR)


query("fd_closure", NR_FDS.replace("WITH src", "WITH RECURSIVE src") + ", paths AS (SELECT lhs, rhs FROM fds UNION SELECT p.lhs, f.rhs FROM paths p JOIN fds f ON p.rhs = f.lhs) SELECT lhs, rhs FROM paths WHERE lhs != rhs")(
    lambda s, sf: dependencies.closure(nr_edges(s, sf))
)
query("bijections_nation", NR_FDS + " SELECT a.lhs AS left_column, a.rhs AS right_column FROM fds a JOIN fds b ON a.lhs = b.rhs AND a.rhs = b.lhs WHERE a.lhs < a.rhs")(lambda s, sf: dependencies.bijections(nr_edges(s, sf)))
query(
    "closest_dependents",
    NR_FDS
    + """ SELECT e.lhs, e.rhs FROM fds e WHERE NOT EXISTS (SELECT 1 FROM fds a JOIN fds b ON a.rhs = b.lhs
    WHERE a.lhs = e.lhs AND b.rhs = e.rhs AND a.rhs != e.rhs AND NOT EXISTS (SELECT 1 FROM fds c WHERE c.lhs = a.rhs AND c.rhs = e.lhs))""",
)(lambda s, sf: dependencies.closest_dependents(nr_edges(s, sf)))
query("top_determinants", fd_sql(NATION_REGION, ["n_nationkey", "n_regionkey"]) + " SELECT DISTINCT lhs AS determinant FROM fds WHERE lhs NOT IN (SELECT rhs FROM fds)")(
    lambda s, sf: dependencies.top_determinants(profile.single_fds(nation_region(s, sf), ["n_nationkey", "n_regionkey"]))
)
query(
    "fd_artifacts_nation",
    NR_FDS
    + ", inside AS ("
    + " UNION ALL ".join(f"SELECT '{x}' AS lhs, '{y}' AS rhs FROM src WHERE n_nationkey % 17 = 0 HAVING bool_and(contains({x}::VARCHAR, {y}::VARCHAR) AND {y}::VARCHAR != '')" for x in NR for y in NR if x != y)
    + ") SELECT lhs, rhs FROM fds WHERE NOT (lhs = 'n_nationkey' AND rhs IN ('n_name', 'n_regionkey')) AND NOT (lhs = 'n_regionkey' AND rhs = 'r_name') AND (lhs, rhs) NOT IN (SELECT (lhs, rhs) FROM inside)",
)(
    lambda s, sf: dependencies.artifacts(
        nation_region(s, sf), nr_edges(s, sf), s.createDataFrame([("n_nationkey", "n_name"), ("n_nationkey", "n_regionkey"), ("n_regionkey", "r_name")], "lhs string, rhs string"), order="n_nationkey"
    )
)
query("fd_violations_events", "SELECT user_id, count(DISTINCT event_type) AS variants, min(event_type) AS example FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")(
    lambda s, sf: profile.fd_violations(table(s, sf, "events"), ["user_id"], ["event_type"]).withColumn("example", F.col("example.event_type"))
)
query("fd_holds_orders", "SELECT o_orderkey, count(DISTINCT (o_custkey, o_orderstatus)) AS variants FROM orders GROUP BY o_orderkey HAVING count(DISTINCT (o_custkey, o_orderstatus)) > 1")(
    lambda s, sf: profile.fd_violations(table(s, sf, "orders"), ["o_orderkey"], ["o_custkey", "o_orderstatus"]).select("o_orderkey", "variants")
)


@query("synthesized_manufacturing")
def synthesized(s: SparkSession, sf: str) -> DataFrame:
    """The profiled model of the manufacturing table under positional headers."""
    made = synth.manufacturing(s).drop("row_idx")
    model = dsl.parse_models(dependencies.synthesize(made, made.columns, ("none",)), "text")
    return model.select("text", F.size("candidate.entities").alias("entities"), F.size("candidate.relationships").alias("relationships"), "parse.lines_rejected")


# --- profiles ---------------------------------------------------------------------------------------------------------

ORDER_TEXT = ["o_orderstatus", "o_orderpriority"]


def union(source: str, columns: list[str], select: str) -> str:
    return " UNION ALL ".join(select.format(c=c, t=source) for c in columns)


query("value_histogram_orders", union("orders", ORDER_TEXT, "SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}"))(lambda s, sf: profile.value_histogram(table(s, sf, "orders"), ORDER_TEXT))
query("requirements_events", "SELECT 'event_type' AS \"column\", event_type AS value, least(2, count(*))::BIGINT AS required FROM events WHERE event_type IS NOT NULL GROUP BY event_type")(
    lambda s, sf: profile.requirements(profile.value_histogram(table(s, sf, "events"), ["event_type"]))
)
PART = ["p_name", "p_brand", "p_type", "p_size"]
query(
    "distinct_profile_part",
    union("part", PART, "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values, sum(length({c}::VARCHAR))::BIGINT AS total_length, count({c}) AS \"values\", count(DISTINCT {c}) <= 50 AS is_target FROM {t}"),
)(lambda s, sf: profile.distinct_profile(table(s, sf, "part"), PART))
query(
    "group_contribution_lineitem",
    union("lineitem", ["l_returnflag", "l_linestatus"], "SELECT l_orderkey, '{c}' AS \"column\", {c} AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY l_orderkey, {c}"),
)(lambda s, sf: profile.group_contribution(table(s, sf, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"]))


def type_sql(columns: dict[str, str], source: str) -> str:
    parts = []
    for name, value in columns.items():
        tests = " ".join(f"WHEN coalesce(bool_and(regexp_full_match(v, '{p}')) FILTER (v != ''), true) THEN '{t}'" for t, p in profile.TYPE_PATTERNS)
        parts.append(f"SELECT '{name}' AS \"column\", CASE {tests} ELSE 'varchar' END AS inferred FROM (SELECT {value} AS v FROM {source})")
    return " UNION ALL ".join(parts)


query(
    "infer_types_orders",
    type_sql({"o_orderkey": "o_orderkey::VARCHAR", "o_orderstatus": "o_orderstatus", "day": "strftime(o_orderdate, '%Y-%m-%d')", "price": "printf('%d.%02d', o_orderkey, 5)"}, "orders"),
)(
    lambda s, sf: profile.infer_types(
        table(s, sf, "orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.format_string("%d.%02d", "o_orderkey", F.lit(5)).alias("price")), ["o_orderkey", "o_orderstatus", "day", "price"]
    )
)
query(
    "infer_types_events",
    type_sql({"user_id": "user_id::VARCHAR", "event_type": "event_type", "at": "strftime(ts, '%Y-%m-%d %H:%M:%S')", "hour": "strftime(ts, '%H:%M')", "nothing": "''"}, "events"),
)(
    lambda s, sf: profile.infer_types(
        table(s, sf, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.date_format("ts", "HH:mm").alias("hour"), F.lit("").alias("nothing")), ["user_id", "event_type", "at", "hour", "nothing"]
    )
)


def unique_sql(source: str, columns: list[str], most: int, accepted: list[list[str]] = ()) -> str:
    combos = [c for size in range(1, most + 1) for c in combinations(columns, size) if not any(set(k) <= set(c) for k in accepted)]
    counts = " UNION ALL ".join(f"SELECT {i} AS position, '{', '.join(c)}' AS \"columns\", {len(c)} AS size, count(*) AS distinct_rows FROM (SELECT DISTINCT {', '.join(c)} FROM {source})" for i, c in enumerate(combos))
    return f"SELECT c.*, r.n AS rows, c.distinct_rows = r.n AS is_unique FROM ({counts}) c, (SELECT count(*) AS n FROM {source}) r"


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
query("unique_combinations_lineitem", unique_sql("lineitem", LINE, 3))(lambda s, sf: profile.unique_combinations(table(s, sf, "lineitem"), LINE, 3))
SUPPLIER = ["s_suppkey", "s_name", "s_nationkey"]
query("accidental_keys_supplier", unique_sql("supplier", SUPPLIER, 2, [["s_suppkey"]]))(lambda s, sf: profile.unique_combinations(table(s, sf, "supplier"), SUPPLIER, 2, [["s_suppkey"]]))

# --- integrity and sets -----------------------------------------------------------------------------------------------

INCLUSIONS = (
    ("orders", "customer", "o_custkey", "c_custkey"),
    ("lineitem", "orders", "l_orderkey", "o_orderkey"),
    ("lineitem", "part", "l_partkey", "p_partkey"),
    ("lineitem", "supplier", "l_suppkey", "s_suppkey"),
    ("customer", "nation", "c_nationkey", "n_nationkey"),
    ("supplier", "nation", "s_nationkey", "n_nationkey"),
    ("nation", "region", "n_regionkey", "r_regionkey"),
    ("customer", "orders", "c_custkey", "o_custkey"),
    ("parsed_records", "raw_records", "run_id", "run_id"),
    ("metrics_records", "parsed_records", "run_id", "run_id"),
    ("documents", "mix_targets", "source", "source"),
)


@query(
    "inclusion_checks",
    " UNION ALL ".join(
        f"SELECT '{c}.{k} in {p}.{q}' AS \"check\", d AS dangling, CASE WHEN d = 0 THEN 'OK' ELSE 'FAIL' END AS status FROM (SELECT count(*) AS d FROM (SELECT DISTINCT {k} FROM {c} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {q} FROM {p} WHERE {q} IS NOT NULL)))"
        for c, p, k, q in INCLUSIONS
    ),
)
def inclusion_checks(s: SparkSession, sf: str) -> DataFrame:
    return integrity.inclusions([(f"{c}.{k} in {p}.{q}", table(s, sf, c), table(s, sf, p), {k: q}) for c, p, k, q in INCLUSIONS])


query("dangling_customers", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(lambda s, sf: integrity.dangling(table(s, sf, "customer"), table(s, sf, "orders"), {"c_custkey": "o_custkey"}))
query("role_stack_nation", "SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS label FROM customer UNION ALL SELECT DISTINCT s_nationkey, s_name FROM supplier")(
    lambda s, sf: integrity.stack([integrity.projection(table(s, sf, "customer"), {"nation": "c_nationkey", "label": "c_mktsegment"}), integrity.projection(table(s, sf, "supplier"), {"nation": "s_nationkey", "label": "s_name"})])
)
query("role_union_nation", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")(
    lambda s, sf: integrity.stack([integrity.projection(table(s, sf, "customer"), {"nation": "c_nationkey"}), integrity.projection(table(s, sf, "supplier"), {"nation": "s_nationkey"})]).distinct()
)
query(
    "binding_coverage",
    """WITH a AS (SELECT name AS entity, unnest(attributes).name AS attribute FROM ref_entities WHERE dataset = 'clinic'), c(col) AS (VALUES ('patient_no'), ('doctor_id'), ('ward_code')),
    b(entity, attribute, col) AS (VALUES ('Patient', 'patient_no', 'patient_no'), ('Doctor', 'doctor_id', 'doctor_id'), ('Ward', 'ward_code', 'ward'))
    SELECT entity, attribute AS name, 'unbound attribute' AS problem FROM a WHERE (entity, attribute) NOT IN (SELECT (entity, attribute) FROM b) UNION ALL SELECT entity, col, 'unknown column' FROM b WHERE col NOT IN (SELECT col FROM c)""",
)(
    lambda s, sf: integrity.binding_coverage(
        s.createDataFrame([("Patient", "patient_no", "patient_no"), ("Doctor", "doctor_id", "doctor_id"), ("Ward", "ward_code", "ward")], "entity string, attribute string, column string"),
        table(s, sf, "ref_entities").where("dataset = 'clinic'").select(F.col("name").alias("entity"), F.explode("attributes").alias("a")).select("entity", F.col("a.name").alias("attribute")),
        s.createDataFrame([("patient_no",), ("doctor_id",), ("ward_code",)], "column string"),
    )
)

# --- samples ----------------------------------------------------------------------------------------------------------

TARGETS = ["o_orderstatus", "o_orderpriority"]


@query(
    "coverage_sample_report",
    union(
        "orders",
        TARGETS,
        "SELECT '{c}' AS \"column\", count(*) AS distinct_full, count(*) AS distinct_in_sample, count(*) FILTER (n >= 2) AS frequent_full, count(*) FILTER (n >= 2) AS frequent_in_sample, count(*) <= 50 AS is_target FROM (SELECT {c}, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c})",
    ),
)
def coverage_sample_report(s: SparkSession, sf: str) -> DataFrame:
    orders = table(s, sf, "orders")
    chosen = sampling.greedy_cover(orders, ["o_custkey"], sampling.coverage_targets(orders, TARGETS))
    return sampling.representativeness(orders, sampling.sample_rows(orders, ["o_custkey"], chosen), TARGETS).drop("coverage_pct")


# The greedy cover step by step: what is missing and who was chosen is one row that each step replaces.
@query(
    "coverage_sample_rows",
    """WITH RECURSIVE given AS (SELECT user_id::VARCHAR AS g, event_type AS v, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL),
    need AS (SELECT list({'v': v, 'm': least(2, n)} ORDER BY v) AS left_over FROM (SELECT event_type AS v, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type)),
    steps(chosen, left_over) AS (SELECT []::VARCHAR[], left_over FROM need
    UNION ALL SELECT list_append(s.chosen, b.g), list_transform(s.left_over, lambda x: {'v': x.v, 'm': greatest(0, x.m - coalesce(list_filter(b.own, lambda o: o.v = x.v)[1].n, 0))})
    FROM steps s, LATERAL (SELECT g, list({'v': v, 'n': n}) AS own FROM given WHERE NOT list_contains(s.chosen, g) GROUP BY g ORDER BY sum(least(n, list_filter(s.left_over, lambda x: x.v = given.v)[1].m)) DESC, g LIMIT 1) b
    WHERE list_sum(list_transform(s.left_over, lambda x: x.m)) > 0)
    SELECT event_id, user_id, event_type, value FROM events WHERE list_contains((SELECT chosen FROM steps ORDER BY len(chosen) DESC LIMIT 1), user_id::VARCHAR)""",
)
def coverage_sample_rows(s: SparkSession, sf: str) -> DataFrame:
    events = table(s, sf, "events")
    return sampling.sample_rows(events, ["user_id"], sampling.greedy_cover(events, ["user_id"], ["event_type"])).select("event_id", "user_id", "event_type", "value")


# --- names, headers, models -------------------------------------------------------------------------------------------

ASCII_CANON = """regexp_replace(CASE WHEN len(p) = 0 THEN '' ELSE concat(array_to_string(p[1:len(p) - 1], ''), CASE
    WHEN p[-1] = 'people' THEN 'person' WHEN p[-1] = 'children' THEN 'child' WHEN p[-1] = 'men' THEN 'man' WHEN p[-1] = 'women' THEN 'woman' WHEN p[-1] = 'data' THEN 'datum' WHEN p[-1] = 'indices' THEN 'index'
    WHEN p[-1] = 'statuses' THEN 'status' WHEN p[-1] IN ('aircraft', 'series') THEN p[-1]
    WHEN p[-1] LIKE '%ies' AND length(p[-1]) > 4 THEN concat(left(p[-1], length(p[-1]) - 3), 'y') WHEN p[-1] LIKE '%ses' AND length(p[-1]) > 4 THEN left(p[-1], length(p[-1]) - 2)
    WHEN p[-1] LIKE '%s' AND p[-1] NOT LIKE '%ss' AND length(p[-1]) > 3 THEN left(p[-1], length(p[-1]) - 1) ELSE p[-1] END) END, '[^a-z0-9]', '', 'g')"""
CANON_SQL = "SELECT name, {c} AS canonical FROM (SELECT name, list_filter(string_split_regex(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[\\s_./-]+'), lambda x: x != '') AS p FROM ({s}))"
query("canon_part_names", CANON_SQL.format(c=ASCII_CANON, s="SELECT DISTINCT p_name AS name FROM part"))(lambda s, sf: table(s, sf, "part").select(F.col("p_name").alias("name")).distinct().select("name", canon(F.col("name")).alias("canonical")))
query("canon_typed_names", CANON_SQL.format(c=ASCII_CANON, s="SELECT DISTINCT e.name AS name FROM (SELECT unnest(candidate.entities) AS e FROM parsed_records) WHERE NOT regexp_matches(e.name, '[^\\x00-\\x7F]')"))(
    lambda s, sf: table(s, sf, "parsed_records").select(F.explode("candidate.entities").alias("e")).select("e.name").distinct().where("NOT name RLIKE '[^\\\\x00-\\\\x7F]'").select("name", canon(F.col("name")).alias("canonical"))
)


# canon_typed_names has the rows of its SQL, ASCII names only; this one has all names, and no SQL, as DuckDB can't check NFKC.
@query("canon_all_names")
def canon_all_names(s: SparkSession, sf: str) -> DataFrame:
    names = table(s, sf, "parsed_records").select(F.explode("candidate.entities").alias("e")).select("e.name").distinct()
    return names.select("name", canon(F.col("name")).alias("canonical"))


query(
    "header_transform",
    "SELECT name, name AS meaningful, concat('c', row_number() OVER (PARTITION BY dataset, entity_ref ORDER BY i)) AS positional, concat('C_', upper(left(sha256(name), 6))) AS cryptic FROM (SELECT dataset, entity_ref, unnest(attributes).name AS name, generate_subscripts(attributes, 1) AS i FROM ref_entities)",
)(
    lambda s, sf: table(s, sf, "ref_entities").select(F.posexplode("attributes").alias("i", "a")).select(F.col("a.name").alias("name"), header(F.col("a.name"), F.col("i") + 1, "meaningful").alias("meaningful"), header(F.col("a.name"), F.col("i") + 1, "none").alias("positional"), header(F.col("a.name"), F.col("i") + 1, "cryptic").alias("cryptic"))
)
query(
    "entity_names",
    """SELECT DISTINCT c, array_to_string(list_transform(CASE WHEN len(k) > 0 THEN k ELSE p END, lambda t: concat(upper(left(t, 1)), lower(t[2:]))), '') AS entity FROM (
    SELECT c, p, list_filter(p, lambda t: lower(t) NOT IN ('id', 'code', 'number', 'n', 'key', 'num')) AS k FROM (SELECT name AS c, list_filter(string_split_regex(name, '[_\\W]+'), lambda t: t != '') AS p FROM (SELECT unnest(attributes).name AS name FROM ref_entities)))""",
)(lambda s, sf: table(s, sf, "ref_entities").select(F.explode("attributes").alias("a")).select(F.col("a.name").alias("c")).distinct().select("c", entity_name(F.col("c")).alias("entity")))

# The records of runs, parsed: the same result as the parsed table, for runs that both have.
# Texts are parsed where they are read; only what is kept of them is shuffled to one row a run.


@query(
    "parsed_models",
    """SELECT run_id, min(len(candidate.entities)) AS entities, min(list_sum([0] || list_transform(candidate.entities, lambda e: len(e.attrs))))::BIGINT AS attributes, min(len(candidate.relationships)) AS relationships,
    min(array_to_string(list_transform(candidate.entities, lambda e: concat(e.name, '(', array_to_string(e.pk, ','), ')')), ';')) AS keys,
    min(array_to_string(list_transform(candidate.relationships, lambda r: concat(r.frm, '>', r.to, ':', r.cf, '>', r.ct, ':', r.fk)), ';')) AS links,
    min(parse.lines_total) AS lines_total, min(parse.lines_rejected) AS lines_rejected, bool_or(parse.parse_failure) AS parse_failure
    FROM parsed_records WHERE run_id IN (SELECT run_id FROM raw_records) GROUP BY run_id""",
)
def parsed_models(s: SparkSession, sf: str) -> DataFrame:
    m = dsl.parse_models(spread(table(s, sf, "raw_records").select("run_id", "raw_id", "response_text")), "response_text")
    found = m.select(
        "run_id",
        "raw_id",
        F.size("candidate.entities").cast("bigint").alias("entities"),
        F.aggregate("candidate.entities", F.lit(0).cast("bigint"), lambda n, e: n + F.size(e["attrs"])).alias("attributes"),
        F.size("candidate.relationships").cast("bigint").alias("relationships"),
        F.array_join(F.transform("candidate.entities", lambda e: F.concat(e["name"], F.lit("("), F.array_join(e["pk"], ","), F.lit(")"))), ";").alias("keys"),
        F.array_join(F.transform("candidate.relationships", lambda r: F.concat(r["frm"], F.lit(">"), r["to"], F.lit(":"), r["cf"], F.lit(">"), r["ct"], F.lit(":"), r["fk"])), ";").alias("links"),
        "parse.lines_total",
        "parse.lines_rejected",
        "parse.parse_failure",
    )
    kept = [c for c in found.columns if c not in ("run_id", "raw_id")]
    first = found.groupBy("run_id").agg(F.min_by(F.struct(*kept), "raw_id").alias("m")).select("run_id", *[f"m.{c}" for c in kept])
    return first.join(table(s, sf, "parsed_records").select("run_id").distinct(), "run_id", "left_semi")


@query("rendered_models", "SELECT parsed_id, true AS same_entities, 0::BIGINT AS lines_rejected FROM parsed_records WHERE candidate IS NOT NULL")
def rendered_models(s: SparkSession, sf: str) -> DataFrame:
    """Parsed models rendered and parsed again: the same entities."""
    p = table(s, sf, "parsed_records").where("candidate is not null").select("parsed_id", F.col("candidate").alias("before"))
    again = dsl.parse_models(spread(p).withColumn("text", dsl.render_model(F.col("before"))), "text")
    return again.select("parsed_id", (F.size("before.entities") == F.size("candidate.entities")).alias("same_entities"), "parse.lines_rejected")


def _dim(d: str) -> str:
    return f"metrics.{d}.tp AS {d.replace('.', '_')}_tp, metrics.{d}.fp AS {d.replace('.', '_')}_fp, metrics.{d}.fn AS {d.replace('.', '_')}_fn"


@query(
    "model_scores",
    f"""SELECT run_id, {", ".join(map(_dim, ("entities", "keys", "keys.pk_only", "keys.fk_only", "attributes")))}, metrics.entities.f1 AS entities_f1
    FROM metrics_records WHERE metrics IS NOT NULL AND run_id IN (SELECT run_id FROM parsed_records WHERE dataset IN (SELECT dataset FROM ref_entities)) """,
)
def model_scores(s: SparkSession, sf: str) -> DataFrame:
    wanted = table(s, sf, "metrics_records").where("metrics is not null").select("run_id")
    runs = table(s, sf, "parsed_records").select("run_id", "parsed_id", "dataset", "candidate")
    scored = scoring.score_models(spread(runs), scoring.references(table(s, sf, "ref_entities"))).groupBy("run_id").agg(F.min_by("scores", "parsed_id").alias("scores")).join(wanted, "run_id", "left_semi")
    names = (("entities", "entities"), ("keys", "keys"), ("pk_only", "keys_pk_only"), ("fk_only", "keys_fk_only"), ("attributes", "attributes"))
    return scored.select("run_id", *[F.col(f"scores.{d}.{c}").alias(f"{n}_{c}") for d, n in names for c in ("tp", "fp", "fn")], scoring.rounded(F.col("scores.entities.f1")).alias("entities_f1"))


def links_of(refs: DataFrame) -> DataFrame:
    """Reference relationships: a foreign-key attribute refers to the entity whose key it ends with."""
    child = refs.select("dataset", F.col("name").alias("child"), F.explode("attributes").alias("a")).where("a.semantic_type = 'ForeignKey'")
    parent = refs.select(F.col("dataset").alias("d"), F.col("name").alias("parent"), F.col("primary_key")[0].alias("pk"))
    rows = child.join(F.broadcast(parent), (F.col("dataset") == F.col("d")) & ((F.col("a.name") == F.col("pk")) | F.col("a.name").endswith(F.concat(F.lit("_"), F.col("pk")))))
    link = F.struct(canon(F.col("parent")).alias("parent"), canon(F.col("child")).alias("child"), F.lit("1:N").alias("klass"), F.array(canon(F.col("a.name"))).alias("fk_cols"))
    return rows.select("dataset", link.alias("l")).groupBy("dataset").agg(F.array_sort(F.collect_list("l")).alias("links"))


@query(
    "relationship_scores",
    "SELECT run_id, metrics.relationships.tp AS tp, metrics.relationships.fp AS fp, metrics.relationships.fn AS fn FROM metrics_records WHERE metrics IS NOT NULL AND run_id IN (SELECT run_id FROM parsed_records WHERE dataset IN (SELECT dataset FROM ref_entities))",
)
def relationship_scores(s: SparkSession, sf: str) -> DataFrame:
    wanted = table(s, sf, "metrics_records").where("metrics is not null").select("run_id")
    runs = table(s, sf, "parsed_records").select("run_id", "parsed_id", "dataset", "candidate")
    refs = table(s, sf, "ref_entities")
    scored = scoring.score_relationships(spread(runs), scoring.references(refs), links_of(refs)).groupBy("run_id").agg(F.min_by("relationships", "parsed_id").alias("relationships"))
    return scored.join(wanted, "run_id", "left_semi").select("run_id", "relationships.tp", "relationships.fp", "relationships.fn")


@query("relaxed_recall")
def relaxed_recall(s: SparkSession, sf: str) -> DataFrame:
    refs = table(s, sf, "ref_entities")
    runs = table(s, sf, "parsed_records").select("run_id", "parsed_id", "dataset", "provider", "cond_id", "candidate")
    scored = scoring.score_relationships(spread(runs), scoring.references(refs), links_of(refs))
    kept = F.struct("dataset", "provider", "cond_id", "relationships", "relaxed_recall")
    scored = scored.groupBy("run_id").agg(F.min_by(kept, "parsed_id").alias("r")).select("run_id", "r.*")
    return scored.groupBy("dataset", "provider", "cond_id").agg(F.count("*").alias("runs"), F.avg("relationships.recall").alias("strict_recall"), F.avg("relaxed_recall").alias("relaxed_recall"))


# --- design -----------------------------------------------------------------------------------------------------------

CONDITIONS = """WITH b(v) AS (VALUES (false), (true)), h(headers, tag, k) AS (VALUES ('meaningful', 'm', 0), ('cryptic', 'c', 1), ('none', 'n', 2)), c AS (
SELECT (d.v::INT * 4 + m.v::INT * 2 + r.v::INT) * 3 + h.k AS position, d.v AS domain, m.v AS dictionary, r.v AS rules, h.headers, concat('k', d.v::INT, m.v::INT, r.v::INT) AS ktag, concat('h', h.tag) AS htag, concat('k', d.v::INT, m.v::INT, r.v::INT, '__h', h.tag) AS cond_id
FROM b d, b m, b r, h)"""
query("design_conditions", CONDITIONS + " SELECT position::INT AS position, domain, dictionary, rules, headers, ktag, htag, cond_id FROM c")(lambda s, sf: design.conditions(s))
MODELS, DATASETS, TEMPERATURES = ["ardent", "boreal"], ["clinic", "library"], [0.0, 0.2, 0.5]
MATRIX = f"""{CONDITIONS}, x AS (SELECT concat(d, '__', m, '__', cond_id, '__t', lpad(round(t * 10)::INT::VARCHAR, 2, '0'), '__r', r) AS run_id, (CASE WHEN t = 0 THEN 42 ELSE 1000 + r END)::BIGINT AS seed
FROM c, (SELECT unnest({MODELS}) AS m), (SELECT unnest({DATASETS}) AS d), (SELECT unnest({TEMPERATURES}) AS t), (SELECT unnest([1, 2, 3]) AS r))"""


def matrix(s: SparkSession) -> DataFrame:
    return design.run_matrix(s, MODELS, DATASETS, TEMPERATURES, 3)


query("run_matrix", MATRIX + " SELECT run_id, seed FROM x")(lambda s, sf: matrix(s).select("run_id", "seed"))
query("pending_runs", MATRIX + " SELECT run_id, seed FROM x WHERE run_id NOT IN (SELECT run_id FROM raw_records)")(lambda s, sf: design.pending(matrix(s), table(s, sf, "raw_records")).select("run_id", "seed"))
query("dictionary_blocks", "SELECT dataset, entity_ref, array_to_string(list_transform(attributes, lambda a: concat('- C_', upper(left(sha256(a.name), 6)), ': ', a.semantic_type)), chr(10)) AS block FROM ref_entities")(
    lambda s, sf: table(s, sf, "ref_entities").select("dataset", "entity_ref", design.dictionary_block(F.transform("attributes", lambda a: F.struct(a["name"].alias("k"), a["semantic_type"].alias("v"))), "cryptic").alias("block"))
)
query("rendered_prompts", "SELECT prompt_file, concat('Task. ', 'DOMAIN', chr(10), dataset, chr(10), chr(10), 'OUTPUT FORMAT', chr(10), cond_id) AS prompt FROM prompts")(
    lambda s, sf: table(s, sf, "prompts").select("prompt_file", design.render(F.lit("Task. OUTPUT FORMAT\n{{DATA_BLOCK}}"), F.concat(F.lit("DOMAIN\n"), F.col("dataset"), F.lit("\n\n")), F.col("cond_id")).alias("prompt"))
)
query("mock_runs", "SELECT prompt_file, 'mock' AS finish_reason, length(prompt_text) // 4 AS input_tokens FROM prompts")(lambda s, sf: design.mock_responses(table(s, sf, "prompts"), "prompt_text").select("prompt_file", "finish_reason", "input_tokens"))
query("prompt_digests", "SELECT prompt_file, CASE WHEN prompt_sha256 = sha256(prompt_text) THEN 'OK' ELSE 'MISMATCH' END AS status FROM prompts")(
    lambda s, sf: integrity.verify(table(s, sf, "prompts").select(F.col("prompt_file").alias("name"), F.col("prompt_sha256").alias("sha256")), table(s, sf, "prompts").select(F.col("prompt_file").alias("name"), F.sha2("prompt_text", 256).alias("sha256"))).withColumnRenamed("name", "prompt_file")
)
# The published digests of both synthetic tables.
query("synthetic_digests", "SELECT * FROM (VALUES ('airlines.csv', 'cc98710193e631dead85d6d6fab3ddb3d9b843ab52dd872ac62d02b892242a01'), ('manufacturing.csv', 'bf3c2c373e95ad3ea22a4a011909a75a901f341677a3dfb5152b89b288b63692')) AS t(name, sha256)")(
    lambda s, sf: synth.build_all(s).select("name", "sha256")
)

# --- aggregates -------------------------------------------------------------------------------------------------------

DIMS = ("entities", "relationships", "keys", "attributes")
LONG = "(" + " UNION ALL ".join(f"SELECT *, '{d}' AS dim, metrics.{d}.precision AS precision, metrics.{d}.recall AS recall, metrics.{d}.f1 AS f1 FROM metrics_records" for d in DIMS) + ")"
CELL = ["provider", "dataset", "cond_id", "temperature"]
query(
    "cell_summary",
    f"SELECT {', '.join(CELL)}, dim, count(*) AS n, count(*) FILTER (parse_failure) AS parse_failures, "
    + ", ".join(f"avg({m}) AS {m}_mean, CASE WHEN count({m}) = 1 THEN 0 ELSE stddev_samp({m}) END AS {m}_sd" for m in ("precision", "recall", "f1"))
    + f" FROM {LONG} GROUP BY {', '.join(CELL)}, dim",
)(lambda s, sf: factorial.cell_summary(table(s, sf, "metrics_records"), CELL))
query(
    "main_effects",
    " UNION ALL ".join(
        f"SELECT provider, dataset, dim, '{f}' AS factor, avg(f1) FILTER (NOT {f}) AS mean_off, avg(f1) FILTER ({f}) AS mean_on, avg(f1) FILTER ({f}) - avg(f1) FILTER (NOT {f}) AS delta FROM {LONG} WHERE abs(temperature) < 1e-9 AND headers = 'meaningful' GROUP BY provider, dataset, dim"
        for f in ("domain", "dictionary", "rules")
    ),
)(lambda s, sf: factorial.main_effects(table(s, sf, "metrics_records"), ["provider", "dataset"]))
query("header_means", f"SELECT provider, dataset, headers, dim, count(f1) AS n, avg(f1) AS mean_f1 FROM {LONG} WHERE abs(temperature) < 1e-9 GROUP BY provider, dataset, headers, dim")(lambda s, sf: factorial.header_means(table(s, sf, "metrics_records"), ["provider", "dataset"]))
query(
    "token_totals",
    "SELECT provider, dataset, count(*) AS runs, sum(coalesce(usage.input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(usage.output_tokens, 0))::BIGINT AS output_tokens, sum(coalesce(usage.input_tokens, 0) + coalesce(usage.output_tokens, 0))::BIGINT AS total_tokens, grouping(provider, dataset)::INT AS level FROM raw_records GROUP BY GROUPING SETS ((), (provider, dataset))",
)(lambda s, sf: factorial.token_totals(table(s, sf, "raw_records")))
query(
    "stability",
    "SELECT provider, dataset, cond_id, temperature, count(*) AS n, count(DISTINCT sha256(coalesce(response_text, ''))) AS distinct_outputs, count(DISTINCT sha256(coalesce(response_text, ''))) = 1 AS all_identical, count(*) - count(DISTINCT sha256(coalesce(response_text, ''))) + 1 AS identical_outputs FROM raw_records WHERE provider != 'baseline' GROUP BY provider, dataset, cond_id, temperature",
)(lambda s, sf: factorial.stability(table(s, sf, "raw_records").where("provider != 'baseline'"), CELL))
query(
    "within_cell_sd",
    f"SELECT provider, temperature, dim, count(*) AS cells, count(sd) AS cells_with_sd, avg(sd) AS mean_sd FROM (SELECT {', '.join(CELL)}, dim, stddev_samp(f1) AS sd FROM {LONG} GROUP BY {', '.join(CELL)}, dim) GROUP BY provider, temperature, dim",
)(lambda s, sf: factorial.within_cell_sd(table(s, sf, "metrics_records"), CELL, ["provider", "temperature"]))


def scores(s: SparkSession, sf: str) -> DataFrame:
    return factorial.long_scores(table(s, sf, "metrics_records"), ["provider", "dataset", "cond_id", "temperature"])


GAPS = f"SELECT dataset, dim, cond_id, temperature, avg(f1) FILTER (provider = 'ardent') AS l, avg(f1) FILTER (provider = 'boreal') AS r FROM {LONG} GROUP BY dataset, dim, cond_id, temperature"
query(
    "model_gap",
    f"""WITH d AS (SELECT dataset, dim, round(l - r, 9) AS d FROM ({GAPS}) WHERE l IS NOT NULL AND r IS NOT NULL), k AS (SELECT *, rank() OVER (PARTITION BY dataset, dim ORDER BY abs(d)) + (count(*) OVER (PARTITION BY dataset, dim, abs(d)) - 1) / 2 AS rank FROM d WHERE d != 0)
    SELECT dataset, dim, count(*) AS pairs, (SELECT count(*) FROM k WHERE k.dataset = d.dataset AND k.dim = d.dim) AS n, coalesce((SELECT sum(rank) FROM k WHERE d > 0 AND k.dataset = d.dataset AND k.dim = d.dim), 0.0) AS w_plus, coalesce((SELECT sum(rank) FROM k WHERE d < 0 AND k.dataset = d.dataset AND k.dim = d.dim), 0.0) AS w_minus FROM d GROUP BY dataset, dim""",
)(
    lambda s, sf: stats.wilcoxon(stats.model_cells(scores(s, sf), ["dataset", "dim", "cond_id", "temperature"], "ardent", "boreal").withColumn("left_f1", F.round(F.col("left_f1") - F.col("right_f1"), 9)).withColumn("right_f1", F.when(F.col("right_f1").isNotNull(), F.lit(0.0))), ["dataset", "dim"], "left_f1", "right_f1").select("dataset", "dim", "pairs", "n", "w_plus", "w_minus")
)


@query(
    "temperature_effect",
    f"""WITH m AS (SELECT provider, dim, dataset, cond_id, temperature, round(avg(f1), 9) AS f FROM {LONG} WHERE f1 IS NOT NULL GROUP BY ALL), b AS (SELECT *, count(*) OVER (PARTITION BY provider, dim, dataset, cond_id) AS k FROM m),
    r AS (SELECT *, rank() OVER (PARTITION BY provider, dim, dataset, cond_id ORDER BY f) + (count(*) OVER (PARTITION BY provider, dim, dataset, cond_id, f) - 1) / 2 AS rank FROM b WHERE k = 3)
    SELECT provider, dim, temperature, count(*) AS blocks, sum(rank) AS rank_sum FROM r GROUP BY provider, dim, temperature""",
)
def temperature_effect(s: SparkSession, sf: str) -> DataFrame:
    cells = scores(s, sf).where("f1 is not null").groupBy("provider", "dim", "dataset", "cond_id", "temperature").agg(F.round(F.avg("f1"), 9).alias("f"))
    from pyspark.sql import Window as W

    full = cells.withColumn("k", F.count("*").over(W.partitionBy("provider", "dim", "dataset", "cond_id"))).where("k = 3")
    ranked = full.withColumn("rank", stats.average_rank(["provider", "dim", "dataset", "cond_id"], F.col("f")))
    return ranked.groupBy("provider", "dim", "temperature").agg(F.count("*").alias("blocks"), F.sum("rank").alias("rank_sum"))
