"""Sources and sinks (SRC1-SRC10, SNK2-SNK9, SC2, SC3): text tables, record folders, prompts, reference models, and writing them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage.functions.text import canon, multiplicity, relation_class

# The schemas of run, parsed and metrics records.
RUN_COLUMNS = "run_id string, provider string, model_requested string, dataset string, cond_id string, domain boolean, dictionary boolean, rules boolean, headers string, temperature double, replicate bigint"
RAW = (
    "run_id string, provider string, model_requested string, model_returned string, dataset string, cond_id string, domain boolean, dictionary boolean, rules boolean, headers string, temperature double, replicate bigint, "
    "seed bigint, top_p double, max_tokens bigint, prompt_sha256 string, prompt_file string, response_text string, finish_reason string, usage struct<input_tokens: bigint, output_tokens: bigint>, thoughts_token_count bigint, "
    "request_payload string, sdk_versions struct<python: string, provider_sdk: string>, ecologits string, ecologits_unavailable_reason string, latency_ms bigint, transport_retries bigint, generated_at string"
)
PRF = "struct<tp: bigint, fp: bigint, fn: bigint, precision: double, recall: double, f1: double>"
METRICS = (
    "run_id string, provider string, dataset string, cond_id string, domain boolean, dictionary boolean, rules boolean, headers string, temperature double, replicate bigint, parse_failure boolean, "
    f"metrics struct<entities: {PRF}, relationships: {PRF}, keys: struct<tp: bigint, fp: bigint, fn: bigint, precision: double, recall: double, f1: double, pk_only: {PRF}, fk_only: {PRF}>, attributes: {PRF}>"
)


REFERENCE = (
    "entities array<struct<name: string, primaryKey: array<string>, candidateKeys: array<array<string>>, attributes: array<struct<name: string, semanticType: string>>>>, "
    "relationships array<struct<name: string, source: string, target: string, role: string, cardinality: struct<source: string, target: string>, "
    "foreignKey: struct<entity: string, attributes: array<string>, references: struct<entity: string, attributes: array<string>>>>>"
)
ALIASES = "map<string, struct<entities: map<string, array<string>>, attributes: map<string, array<string>>>>"


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """SRC1-SRC3: a CSV with header, every column as text, quotes honoured, lines within quotes too."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


def read_records(spark: SparkSession, folder: str, schema: str, names: str = "*.json") -> DataFrame:
    """SRC4-SRC8, SNK9: a record a file; files that aren't JSON keep their text in ``corrupt``. ``names`` selects files by glob."""
    return spark.read.schema(f"{schema}, corrupt string").option("multiLine", True).option("pathGlobFilter", names).option("columnNameOfCorruptRecord", "corrupt").json(folder)


def read_texts(spark: SparkSession, folder: str, names: str = "*.txt") -> DataFrame:
    """SRC9: (path, text): a file a row."""
    return spark.read.option("pathGlobFilter", names).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_settings(path: str) -> dict[str, str]:
    """SRC10: KEY=VALUE lines; comments and lines without = are skipped, the first = splits."""
    lines = (line.strip() for line in Path(path).read_text(encoding="utf-8").splitlines())
    return {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in lines if "=" in x and not x.startswith("#"))}


def read_aliases(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """SC3: one row (entities, attributes), the aliases of a dataset by name and by ``entity.attribute``; both empty without a file or an entry."""
    none = F.from_json(F.lit("{}"), "map<string, array<string>>")
    if not path_exists(spark, path):
        return spark.range(1).select(none.alias("entities"), none.alias("attributes"))
    own = F.from_json("value", ALIASES)[dataset]
    return spark.read.text(path, wholetext=True).select(F.coalesce(own["entities"], none).alias("entities"), F.coalesce(own["attributes"], none).alias("attributes"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(conf).exists(place)


def read_reference(spark: SparkSession, path: str, dataset: str, aliases: str = "") -> tuple[DataFrame, DataFrame]:
    """SC2, SC3: a reference model's entities, as ``scoring.references`` takes them, and its links, as ``scoring.score_relationships`` does."""
    document = spark.read.schema(REFERENCE).option("multiLine", True).json(path)
    also = read_aliases(spark, aliases or f"{path}.aliases", dataset).select(F.col("entities").alias("entity_names"), F.col("attributes").alias("attribute_names"))
    rows = document.select(F.posexplode("entities").alias("entity_ref", "e")).crossJoin(F.broadcast(also))  # one row of aliases
    own = F.transform("e.attributes", lambda a: F.struct(a["name"].alias("key"), F.coalesce(F.try_element_at(F.col("attribute_names"), F.concat(F.col("e.name"), F.lit("."), a["name"])), F.array().cast("array<string>")).alias("value")))
    entities = rows.select(
        F.lit(dataset).alias("dataset"), F.col("entity_ref").cast("bigint").alias("entity_ref"), "e.name", F.coalesce(F.try_element_at(F.col("entity_names"), F.col("e.name")), F.array().cast("array<string>")).alias("aliases"),
        F.coalesce("e.primaryKey", F.array().cast("array<string>")).alias("primary_key"), F.col("e.candidateKeys").alias("candidate_keys"),
        F.transform("e.attributes", lambda a: F.struct(a["name"].alias("name"), a["semanticType"].alias("semantic_type"))).alias("attributes"), F.map_from_entries(own).alias("attribute_aliases"),
    )
    klass = relation_class(multiplicity(F.col("r.cardinality.source")), multiplicity(F.col("r.cardinality.target")))
    columns = F.transform(F.coalesce("r.foreignKey.attributes", F.array().cast("array<string>")), canon)
    link = F.struct(canon(F.col("r.source")).alias("parent"), canon(F.col("r.target")).alias("child"), klass.alias("klass"), columns.alias("fk_cols"))
    links = document.select(F.posexplode("relationships").alias("i", "r")).select("i", link.alias("l")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "l"))), lambda x: x["l"]).alias("links"))
    return entities, links.select(F.lit(dataset).alias("dataset"), "links")


def valid_records(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """SNK9: (name, status) of the wanted file names: valid, corrupt (no JSON) or missing."""
    status = F.when(F.expr("try_parse_json(value)").isNotNull(), "valid").otherwise("corrupt")
    found = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), status.alias("status"))
    return wanted.select("name").join(found, "name", "left").select("name", F.coalesce("status", F.lit("missing")).alias("status"))


def write_prompts(df: DataFrame, folder: str) -> None:
    """SNK6: (name, text): a folder a name with the text in one file; the writer ends it with a line end."""
    df.select("name", "text").write.partitionBy("name").text(folder)


def read_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of what ``write_prompts`` wrote."""
    return spark.read.text(folder, wholetext=True).select("name", F.regexp_replace("value", r"\n\z", "").alias("text"))


def write_records(df: DataFrame, folder: str, by: list[str]) -> None:
    """SNK3, SNK4: records as JSON lines, a folder a partition value; the committer makes the write atomic."""
    df.write.partitionBy(*by).mode("errorifexists").json(folder)


def write_csv(df: DataFrame, folder: str, order: str) -> None:
    """SNK2: a sorted CSV with header; the order is across files."""
    df.orderBy(order).drop(order).write.option("header", True).option("escape", '"').csv(folder)


def nested_json(df: DataFrame, levels: list[str], value: list[str]) -> DataFrame:
    """SNK5: a flat aggregate as JSON, an object a row of the first level: (first level, json); for result-sized tables."""
    out = df.select(*[F.col(c).cast("string").alias(c) for c in levels], F.struct(*value).alias("_value"))
    for depth in range(len(levels) - 1, 0, -1):
        out = out.groupBy(*levels[:depth]).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(levels[depth], "_value")), lambda a, b: F.when(a[levels[depth]] < b[levels[depth]], -1).when(a[levels[depth]] > b[levels[depth]], 1).otherwise(0))).alias("_value"))
    return out.select(levels[0], F.to_json("_value").alias("json"))
