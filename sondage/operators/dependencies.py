"""Graphs of dependencies: closure, bijections, closest dependents, artifacts, synthesis (PF7-PF17).

Edges are at most columns x columns: metadata, whose size the schema bounds. All steps are relational; a table is profiled once,
whatever its headers are called, and the models of all header variants come out of one query over that metadata.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.functions.text import entity_name, header
from sondage.operators.profile import distinct_profile, infer_types, minimal_unique_combination, single_fds
from sondage.session import checkpoint


def closure(edges: DataFrame) -> DataFrame:
    """PF8, JN15: all (lhs, rhs) reachable, without lhs = rhs. Paths double each round, so rounds grow with the logarithm of the longest."""
    paths = edges.select("lhs", "rhs").distinct()
    size = -1
    while True:
        paths = checkpoint(paths)
        count = paths.count()
        if count == size:
            return paths.where("lhs != rhs")
        size = count
        steps = paths.alias("a").join(paths.alias("b"), F.col("a.rhs") == F.col("b.lhs")).select("a.lhs", "b.rhs")
        paths = paths.unionByName(steps).distinct()


def bijections(edges: DataFrame) -> DataFrame:
    """PF10: pairs of columns that determine each other, each once."""
    back = edges.select(F.col("rhs").alias("lhs"), F.col("lhs").alias("rhs"))
    return edges.join(back, ["lhs", "rhs"], "left_semi").where("lhs < rhs").select(F.col("lhs").alias("left_column"), F.col("rhs").alias("right_column"))


def closest_dependents(edges: DataFrame) -> DataFrame:
    """PF12: edges x -> y without a determinant z, z != y, such that x -> z, z -> y and not z -> x."""
    e, f, g = edges.alias("e"), edges.alias("f"), edges.select(F.col("lhs").alias("back_lhs"), F.col("rhs").alias("back_rhs"))
    two = e.join(f, F.col("e.rhs") == F.col("f.lhs")).select(F.col("e.lhs").alias("lhs"), F.col("e.rhs").alias("z"), F.col("f.rhs").alias("rhs")).where("z != rhs")
    closer = two.join(g, (F.col("z") == F.col("back_lhs")) & (F.col("lhs") == F.col("back_rhs")), "left_anti").select("lhs", "rhs").distinct()
    return edges.join(closer, ["lhs", "rhs"], "left_anti")


def top_determinants(edges: DataFrame) -> DataFrame:
    """PF13: determinants that no other determinant determines."""
    return edges.select(F.col("lhs").alias("determinant")).distinct().join(edges.where("lhs != rhs").select(F.col("rhs").alias("determinant")), "determinant", "left_anti")


def artifacts(df: DataFrame, mined: DataFrame, expected: DataFrame, step: int = 17, order: str | None = None) -> DataFrame:
    """PF9, ST4, FIL10, SF28: mined edges that are neither expected nor entailed because one value contains the other in every sampled row."""
    rest = mined.join(expected, ["lhs", "rhs"], "left_anti")
    columns = sorted({c for r in rest.collect() for c in r})
    if not columns:
        return rest
    sampled = df.where(F.pmod(F.col(order), F.lit(step)) == 0) if order else df
    text = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns}
    pairs = F.array(*[F.struct(F.lit(x).alias("lhs"), F.lit(y).alias("rhs"), (F.contains(text[x], text[y]) & (text[y] != "")).alias("inside")) for x in columns for y in columns if x != y])
    entailed = sampled.select(F.explode(pairs).alias("p")).groupBy("p.lhs", "p.rhs").agg(F.bool_and("p.inside").alias("inside")).where("inside")
    return rest.join(entailed, ["lhs", "rhs"], "left_anti")


def representatives(profile: DataFrame, edges: DataFrame) -> DataFrame:
    """PF10, SO3: (model, column, stands_for): columns that determine each other form a class, which its member of most dependents, then shortest values, then least name represents.

    profile: (model, column, mean_length); edges: (model, lhs, rhs), closed as exact dependencies are.
    """
    width = edges.groupBy("model", F.col("lhs").alias("column")).agg(F.count("*").alias("dependents"))
    rated = profile.join(width, ["model", "column"], "left").select("model", "column", F.struct(-F.coalesce("dependents", F.lit(0)), "mean_length", "column").alias("rank"))
    back = edges.select("model", F.col("rhs").alias("lhs"), F.col("lhs").alias("rhs"))
    mutual = edges.join(back, ["model", "lhs", "rhs"], "left_semi").select("model", F.col("lhs").alias("column"), F.col("rhs").alias("member"))
    members = mutual.unionByName(profile.select("model", "column", F.col("column").alias("member")))
    ranked = members.join(rated.withColumnRenamed("column", "member"), ["model", "member"])
    return ranked.groupBy("model", "column").agg(F.min_by("member", "rank").alias("stands_for"))


# The findings of which a model's text consists, a line each with its place: {columns} (model, column, position, inferred, entity), {edges} (model, lhs, rhs), {standing} (model, column, stands_for).
HEADS = """
SELECT s.model, s.column AS head, c.entity FROM {standing} s JOIN {columns} c ON s.model = c.model AND s.column = c.column
WHERE s.column = s.stands_for AND EXISTS (SELECT 1 FROM {edges} e WHERE e.model = s.model AND e.lhs = s.column)
"""
NEAR = """
SELECT e.model, e.lhs AS head, e.rhs AS near FROM {edges} e JOIN {heads} h ON e.model = h.model AND e.lhs = h.head
WHERE NOT EXISTS (SELECT 1 FROM {edges} f JOIN {heads} z ON f.model = z.model AND f.rhs = z.head JOIN {edges} g ON g.model = f.model AND g.lhs = f.rhs
                  WHERE f.model = e.model AND f.lhs = e.lhs AND g.rhs = e.rhs AND f.rhs != e.rhs AND NOT EXISTS (SELECT 1 FROM {edges} b WHERE b.model = f.model AND b.lhs = f.rhs AND b.rhs = f.lhs))
"""
# Columns that no entity has taken, in their order, then the heads that no other head determines: the last entity's columns.
REST = """
SELECT c.model, c.column, struct(0 AS part, c.position, '' AS name) AS place, false AS refers FROM {columns} c
WHERE NOT EXISTS (SELECT 1 FROM {heads} h WHERE h.model = c.model AND h.head = c.column) AND NOT EXISTS (SELECT 1 FROM {near} n WHERE n.model = c.model AND n.near = c.column)
UNION ALL
SELECT h.model, h.head, struct(1, 0, h.head), true FROM {heads} h WHERE NOT EXISTS (SELECT 1 FROM {edges} e JOIN {heads} z ON e.model = z.model AND e.lhs = z.head WHERE e.model = h.model AND e.rhs = h.head AND e.lhs != h.head)
"""
LINES = """
WITH named AS (SELECT n.*, h.entity, t.inferred, r.head IS NOT NULL AS refers, r.entity AS referred FROM {near} n JOIN {heads} h ON n.model = h.model AND n.head = h.head
               JOIN {columns} t ON n.model = t.model AND n.near = t.column LEFT JOIN {heads} r ON n.model = r.model AND n.near = r.head),
keyed AS (SELECT model, explode(key) AS column FROM {keys})
SELECT model, struct(1 AS block, entity AS a, head AS b, 0 AS c, 0 AS d, '' AS e) AS place, concat('ENTITY ', entity) AS line FROM {heads}
UNION ALL SELECT model, struct(1, entity, head, 1, 0, ''), concat('PK ', head) FROM {heads}
UNION ALL SELECT h.model, struct(1, h.entity, h.head, 2, 0, ''), concat('ATTR ', h.head, ' : ', t.inferred, ' : PK') FROM {heads} h JOIN {columns} t ON h.model = t.model AND h.head = t.column
UNION ALL SELECT model, struct(1, entity, head, 3, 0, near), concat('ATTR ', near, ' : ', inferred, if(refers, ' : FK', '')) FROM named
UNION ALL SELECT model, struct(2, '', '', 0, 0, ''), 'ENTITY Record' FROM {keys}
UNION ALL SELECT model, struct(2, '', '', 1, 0, ''), concat('PK ', array_join(key, ', ')) FROM {keys}
UNION ALL SELECT r.model, struct(2, '', '', 2 + r.place.part, r.place.position, r.place.name), concat('ATTR ', r.column, ' : ', t.inferred, if(k.column IS NOT NULL, ' : PK', ''), if(r.refers, ' : FK', ''))
          FROM {rest} r JOIN {columns} t ON r.model = t.model AND r.column = t.column LEFT JOIN keyed k ON r.model = k.model AND r.column = k.column
UNION ALL SELECT r.model, struct(3, '', '', 0, 0, r.column), concat('REL Record -> ', h.entity, ' : 0..N -> 1 : FK=', r.column) FROM {rest} r JOIN {heads} h ON r.model = h.model AND r.column = h.head WHERE r.refers
UNION ALL SELECT model, struct(4, entity, head, 0, 0, near), concat('REL ', entity, ' -> ', referred, ' : 0..N -> 1 : FK=', near) FROM named WHERE refers
"""


def synthesize(df: DataFrame, columns: list[str], modes: tuple[str, ...] = ("meaningful",)) -> DataFrame:
    """PF11-PF17: (headers, text): the table's model in the line language, from its types and dependencies, for each way to write its headers.

    The data are read for types, lengths and dependencies once, and once a level for the keys of the rest.
    """
    spark = df.sparkSession
    facts = infer_types(df, columns).join(distinct_profile(df, columns).selectExpr("column", "total_length / greatest(1, values) AS mean_length"), "column", "left")
    places = spark.createDataFrame([(c, i) for i, c in enumerate(columns)], "column string, position int")
    facts = checkpoint(places.join(facts, "column", "left").fillna({"mean_length": 0.0, "inferred": "integer"}))
    mined = checkpoint(single_fds(df, columns))
    headers = [places.select(F.lit(m).alias("model"), F.col("column").alias("source"), header(F.col("column"), F.col("position") + 1, m).alias("column")) for m in modes]
    names = checkpoint(_stacked(headers))
    full = names.join(facts.withColumnRenamed("column", "source"), "source").withColumn("entity", entity_name(F.col("column")))
    full = checkpoint(full.withColumn("entity", F.when(F.col("entity") != "", F.col("entity")).otherwise(F.col("column"))))
    left, right = names.select("model", F.col("source").alias("lhs"), F.col("column").alias("l")), names.select("model", F.col("source").alias("rhs"), F.col("column").alias("r"))
    edges = checkpoint(mined.join(left, "lhs").join(right, ["model", "rhs"]).select("model", F.col("l").alias("lhs"), F.col("r").alias("rhs")))
    standing = checkpoint(representatives(full.select("model", "column", "mean_length"), edges))
    heads = checkpoint(spark.sql(HEADS, standing=standing, columns=full, edges=edges))
    near = checkpoint(spark.sql(NEAR, edges=edges, heads=heads))
    rest = checkpoint(spark.sql(REST, columns=full, heads=heads, near=near, edges=edges))
    keys = spark.createDataFrame(_keys(df, columns, modes, rest, names), "model string, key array<string>")
    lines = spark.sql(LINES, near=near, heads=heads, columns=full, rest=rest, keys=keys, standing=standing)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"])
    return lines.groupBy(F.col("model").alias("headers")).agg(F.array_join(ordered, "\n").alias("text"))


def _stacked(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _keys(df: DataFrame, columns: list[str], modes: tuple[str, ...], rest: DataFrame, names: DataFrame) -> list[tuple[str, list[str]]]:
    """The key of each variant's last entity, in its headers; equal sets of columns are tested once."""
    source = {(r["model"], r["column"]): r["source"] for r in names.collect()}
    order = {m: [r["column"] for r in rest.where(F.col("model") == m).orderBy("place").collect()] for m in modes}
    tested: dict[tuple[str, ...], list[str]] = {}
    out = []
    for mode, own in order.items():
        wanted = tuple(source[mode, c] for c in own) or tuple(columns)
        if wanted not in tested:
            tested[wanted] = minimal_unique_combination(df, list(wanted))
        back = {source[mode, c]: c for m, c in source if m == mode}
        out.append((mode, [back[c] for c in tested[wanted]]))
    return out
