"""Experiment design, run matrix and prompts (SRC13, SRC14, JN3, JN4, CP1, CP6, FIL8-FIL9, SF14-SF24)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions.text import header, run_id

# Header levels with their tags.
HEADERS = (("meaningful", "m"), ("cryptic", "c"), ("none", "n"))


def conditions(spark: SparkSession) -> DataFrame:
    """SRC13, SF24: the 24 conditions, with their place in the fixed order."""
    flags = [(d, m, r) for d in (False, True) for m in (False, True) for r in (False, True)]
    rows = [(i * 3 + k, d, m, r, h, f"k{int(d)}{int(m)}{int(r)}", f"h{t}") for i, (d, m, r) in enumerate(flags) for k, (h, t) in enumerate(HEADERS)]
    df = spark.createDataFrame(rows, "position int, domain boolean, dictionary boolean, rules boolean, headers string, ktag string, htag string")
    return df.withColumn("cond_id", F.concat_ws("__", "ktag", "htag"))


def run_matrix(spark: SparkSession, models: list[str], datasets: list[str], temperatures: list[float], replicates: int) -> DataFrame:
    """JN3: every model, dataset, condition, temperature and replicate (sides of a few rows each, from the configuration)."""
    side = lambda name, kind, values: spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    runs = side("model", "string", models)
    for other in (side("dataset", "string", datasets), conditions(spark), side("temperature", "double", temperatures), side("replicate", "int", range(1, replicates + 1))):
        runs = runs.crossJoin(F.broadcast(other))
    seed = F.when(F.col("temperature") == 0, 42).otherwise(1000 + F.col("replicate"))
    return runs.withColumn("run_id", run_id(F.col("dataset"), F.col("model"), F.col("cond_id"), F.col("temperature"), F.col("replicate"))).withColumn("seed", seed.cast("bigint"))


def pending(matrix: DataFrame, done: DataFrame) -> DataFrame:
    """JN4, CP1: runs without a record."""
    return matrix.join(done.select("run_id").where("run_id is not null").distinct(), "run_id", "left_anti")


def only_cell(runs: DataFrame, dataset: str, cond_id: str, temperature: float, replicate: int) -> DataFrame:
    """FIL8: the runs of one cell and replicate."""
    return runs.where((F.col("dataset") == dataset) & (F.col("cond_id") == cond_id) & (F.abs(F.col("temperature") - temperature) < 1e-9) & (F.col("replicate") == replicate))


def pilot(runs: DataFrame) -> DataFrame:
    """FIL9: the slice with all knowledge and meaningful headers, at temperature 0, first replicate."""
    return runs.where((F.col("cond_id") == "k111__hm") & (F.abs("temperature") < 1e-9) & (F.col("replicate") == 1))


def campaign(runs: DataFrame, done: DataFrame, prompts: DataFrame, generate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """CP1, CP6, SRC14: records of the runs that have none: their prompt (by dataset and cond_id), its digest and what ``generate`` adds to them.

    ``generate`` takes and gives a DataFrame with the column ``prompt_text``, so a model may be called by ``mapInPandas``, a partition at a time.
    """
    asked = prompts.groupBy("dataset", "cond_id").agg(F.min_by(F.struct("prompt_file", "prompt_text"), "prompt_file").alias("p"))
    waiting = pending(runs, done).join(asked, ["dataset", "cond_id"])
    return generate(waiting.select(*runs.columns, "p.prompt_file", "p.prompt_text")).withColumn("prompt_sha256", F.sha2("prompt_text", 256))


def dictionary_block(entries: Column, mode: str) -> Column:
    """SF15: lines ``- header: meaning`` of array<struct<k, v>>, in its order."""
    return F.array_join(F.transform(entries, lambda e, i: F.concat(F.lit("- "), header(e["k"], i + 1, mode), F.lit(": "), e["v"])), "\n")


# The headings of the blocks of a prompt and the note above its data (SF16, SF17).
DOMAIN_TEXT = "DOMAIN CONTEXT (provided by a domain expert)\nThis dataset is about {}.\n\n"
DICTIONARY_TEXT = "DATA DICTIONARY (provided by a domain expert)\nThe meaning of each column is:\n{}\n\n"
RULES_TEXT = "BUSINESS RULES AND CONSTRAINTS (provided by a domain expert)\nThe following rules and constraints govern the domain and must be reflected in the ERD:\n{}\n\n"
DATA_NOTE = "The following is a representative sample of {} rows from a larger dataset of 1000 rows.\n\n"


def _filled(text: str, value: Column) -> Column:
    before, _, after = text.partition("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def knowledge_blocks(domain: Column, dictionary: Column, rules: Column, flags: tuple[Column, Column, Column]) -> Column:
    """SF16: the blocks whose flag is set, in this order: domain, dictionary (already a block), rules (an array) as bullets."""
    bullets = F.array_join(F.transform(rules, lambda r: F.concat(F.lit("- "), r)), "\n")
    texts = (_filled(DOMAIN_TEXT, domain), _filled(DICTIONARY_TEXT, dictionary), _filled(RULES_TEXT, bullets))
    return F.concat(*[F.when(flag, text).otherwise("") for flag, text in zip(flags, texts, strict=True)])


def data_block(columns: Column, rows: Column, mode: str) -> Column:
    """SF17: the note, the header (an array) as ``mode`` writes it, and the rows (an array of lines)."""
    names = F.array_join(F.transform(columns, lambda c, i: header(c, i + 1, mode)), ",")
    return F.concat(_filled(DATA_NOTE, F.size(rows).cast("string")), names, F.lit("\n"), F.array_join(rows, "\n"))


def render(base: Column, blocks: Column, data: Column) -> Column:
    """SF18: ``blocks`` before the first OUTPUT FORMAT (at the end without one), the data in its place; an error if a placeholder is left."""
    at = F.locate("OUTPUT FORMAT", base)
    joined = F.when(at > 0, F.concat(F.substring(base, F.lit(1), at - 1), blocks, F.substring(base, at, F.length(base)))).otherwise(F.concat(base, blocks))
    text = F.replace(joined, F.lit("{{DATA_BLOCK}}"), data)
    return F.when(F.contains(text, F.lit("{{")), F.raise_error(F.lit("a placeholder is left in the prompt"))).otherwise(text)


def mock_responses(prompts: DataFrame, text: str) -> DataFrame:
    """SRC14, CP6: the mock model: a constant answer and token estimates of a quarter of the characters."""
    answer = "ENTITY Thing\nPK id\nATTR id: integer : PK\nATTR label: varchar"
    return prompts.select(
        "*", F.lit(answer).alias("response_text"), F.lit("mock").alias("finish_reason"), F.floor(F.length(text) / 4).cast("bigint").alias("input_tokens"), F.lit(len(answer) // 4).cast("bigint").alias("output_tokens")
    )
