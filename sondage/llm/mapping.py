"""Mapping of freely typed names to a reference list by a partition-based pigeonhole join, in SQL only (p5).

Every reference string is cut into k+1 segments, k being the number of edits that its length allows. A typed string
within k edits holds one of the segments unchanged, at a position that the edits before it and after it can move only so
far; so typed strings are joined to segments by equality of substrings and verified with the built-in levenshtein. What
no join reaches is reported by an anti-join as entity 0. Nothing is capped: the typed strings are distinct, and a
segment's matches are verified all.

Reference strings are names and aliases as words without separators, their plurals, and their shortenings: words without
later vowels or cut to four letters. Typed names lose compatibility forms, accents, schema and table prefixes, and
trailing decorations before the match.

Defined results: a null or empty name, and a name in a dataset without references, is 0; rows whose array is null give
nothing; equally near entries are decided by kind of string, then by swapped letters, then by the lower reference.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.text import nfkc
from sondage.session import checked_broadcast, checkpoint

# What typed table names carry besides the name.
PREFIXES = r"^(?:(?:public|src|core|dbo|main|raw|app|stage|staging|prod|dev|dwh|dw|ods|mart|schema)\.|(?:stg|tbl|tb|t|dim|fact|fct|vw|v|raw|src|ref|tmp|ods)[_ ]+)"
SUFFIXES = r"(?:[ _-]*(?:\([^()]*\)|\[[^\[\]]*\]|(?<=[A-Za-z.])[ _-]*v?[0-9]+|(?<=[a-z.])(?:Entity|Table|Record|Info|Data|Master|View|Type|Class|Model)|[ _-](?i:entity|table|record|records|info|data|master|view|tbl)))+$"
PLAIN_SUFFIX = r"(?i)(?<=[a-z.]{3})[_ -](?:entity|table|record|info|data|master)$"


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Letters with a mark and their base letters, from the Unicode tables."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])]
    kept = [(c, b) for c, b in pairs if b != c and b.isascii()]
    return "".join(c for c, _ in kept), "".join(b for _, b in kept)


def plain(name: Column) -> Column:
    """A typed name without marks, prefixes and decorations, as lower-case letters and digits."""
    bare = F.regexp_replace(nfkc(name), r"\p{M}|[​-‍﻿]", "")
    bare = F.regexp_replace(F.trim(F.translate(bare, *_accents())), r"""^["'`*<]+|["'`*>]+$""", "")
    bare = F.regexp_replace(bare, PREFIXES, "")
    bare = F.regexp_replace(F.regexp_replace(bare, SUFFIXES, ""), SUFFIXES, "")
    return F.regexp_replace(F.lower(bare), "[^a-z0-9]", "")


REFERENCES = """
WITH named AS (
  SELECT dataset, entity_ref, explode(array_append(coalesce(aliases, array()), name)) AS name FROM {refs}
), worded AS (
  SELECT dataset, entity_ref, filter(split(lower(regexp_replace(name, '(?<=[a-z0-9])(?=[A-Z])', ' ')), '[^a-z0-9]+'), w -> w != '') AS words
  FROM named WHERE name IS NOT NULL
), formed AS (
  SELECT dataset, entity_ref, form.kind, form.text FROM (
    SELECT dataset, entity_ref, explode(array(
      struct(0 AS kind, array_join(words, '') AS text),
      struct(2 AS kind, array_join(transform(words, w -> concat(left(w, 1), regexp_replace(substr(w, 2), '[aeiou]', ''))), '') AS text),
      struct(2 AS kind, array_join(transform(words, w -> left(w, 4)), '') AS text))) AS form
    FROM worded)
), counted AS (
  SELECT dataset, entity_ref, kind, text FROM formed
  UNION ALL SELECT dataset, entity_ref, kind + 1, concat(text, 's') FROM formed
  UNION ALL SELECT dataset, entity_ref, kind + 1, concat(text, 'es') FROM formed
  UNION ALL SELECT dataset, entity_ref, kind + 1, regexp_replace(text, 'y$', 'ies') FROM formed WHERE kind = 0 AND text LIKE '%y'
)
SELECT dataset, entity_ref, text, min(kind) AS kind,
  CASE WHEN min(kind) > 1 THEN 0 WHEN length(text) < 9 THEN 2 ELSE 4 END AS k
FROM counted WHERE length(text) > 0 GROUP BY dataset, entity_ref, text
"""

EXACT = """
SELECT t.dataset, t.text, min_by(r.entity_ref, struct(r.kind, r.entity_ref)) AS entity_ref
FROM {typed} t JOIN {references} r ON t.dataset = r.dataset AND t.text = r.text GROUP BY t.dataset, t.text
"""

REST = "SELECT t.dataset, t.text FROM {typed} t LEFT ANTI JOIN {exact} e ON t.dataset = e.dataset AND t.text = e.text"

# Segment i of a string of length n cut into k+1: the last n % (k+1) segments are longer by one.
SEGMENTS = """
SELECT dataset, entity_ref, kind, k, text, n, i, start, size, substr(text, start, size) AS segment FROM (
  SELECT *, n DIV (k + 1) + CASE WHEN i > k - n % (k + 1) THEN 1 ELSE 0 END AS size,
    1 + i * (n DIV (k + 1)) + greatest(0, i - (k + 1 - n % (k + 1))) AS start
  FROM (SELECT *, length(text) AS n, explode(sequence(0, k)) AS i FROM {references} WHERE k > 0 AND length(text) > k))
"""

# Where a typed string of length m may hold the segment: at most i edits lie before it and k - i after it.
SUBSTRINGS = """
WITH shapes AS (SELECT DISTINCT dataset, k, n, i, start, size FROM {segments}),
places AS (
  SELECT dataset, m, k, n, i, size, explode(sequence(low, high)) AS place FROM (
    SELECT *, greatest(1, start - i, start + (m - n) - (k - i)) AS low, least(m - size + 1, start + i, start + (m - n) + (k - i)) AS high
    FROM (SELECT *, explode(sequence(greatest(1, n - k), n + k)) AS m FROM shapes))
  WHERE high >= low
)
SELECT DISTINCT t.dataset, t.text, p.k, p.n, p.i, substr(t.text, p.place, p.size) AS segment
FROM {typed} t JOIN places p ON t.dataset = p.dataset AND length(t.text) = p.m
"""

NEAR = """
WITH pairs AS (
  SELECT DISTINCT s.dataset, s.text, g.text AS reference, g.entity_ref, g.kind, g.k
  FROM {substrings} s JOIN {segments} g ON s.dataset = g.dataset AND s.k = g.k AND s.n = g.n AND s.i = g.i AND s.segment = g.segment
), verified AS (
  SELECT *, array_sort(split(text, '')) = array_sort(split(reference, '')) AS swapped, levenshtein(text, reference, k) AS edits FROM pairs
)
SELECT dataset, text, min_by(entity_ref, struct(edits - CASE WHEN swapped THEN 1 ELSE 0 END, kind, NOT swapped, entity_ref)) AS entity_ref
FROM verified
WHERE edits >= 0 AND (swapped OR edits <= CASE WHEN length(reference) < 6 THEN 1 WHEN length(reference) < 9 THEN 2 WHEN length(reference) < 12 THEN 3 ELSE 4 END)
GROUP BY dataset, text
"""

FOUND = """
SELECT dataset, text, entity_ref FROM {exact}
UNION ALL SELECT dataset, text, entity_ref FROM {near}
UNION ALL SELECT t.dataset, t.text, 0L FROM {rest} t LEFT ANTI JOIN {near} n ON t.dataset = n.dataset AND t.text = n.text
"""

NAMED = """
SELECT n.dataset, n.name, CAST(coalesce(f.entity_ref, 0) AS BIGINT) AS entity_ref
FROM {names} n LEFT JOIN {found} f ON n.dataset <=> f.dataset AND n.text = f.text
"""


def map_names(typed: DataFrame, refs: DataFrame) -> DataFrame:
    """(dataset, name, entity_ref) of the distinct names in ``typed`` (dataset, name); 0 where nothing is meant."""
    sql = typed.sparkSession.sql
    names = typed.distinct().select("dataset", "name", F.coalesce(plain(F.col("name")), F.lit("")).alias("text"))
    names = checkpoint(names)
    texts = names.select("dataset", "text").distinct()
    references = checkpoint(sql(REFERENCES, refs=refs.select("dataset", "entity_ref", "name", "aliases")))
    exact = checkpoint(sql(EXACT, typed=texts, references=references))
    rest = checkpoint(sql(REST, typed=texts, exact=exact))
    segments = checkpoint(sql(SEGMENTS, references=references))
    near = checkpoint(sql(NEAR, substrings=sql(SUBSTRINGS, typed=rest, segments=segments), segments=segments))
    found = sql(FOUND, exact=exact, near=near, rest=rest)
    return sql(NAMED, names=names, found=found)


def map_entities(parsed: DataFrame, refs: DataFrame) -> DataFrame:
    """(parsed_id, pos, dataset, name, entity_ref) of every entity whose name isn't literally a reference name of its dataset."""
    typed = parsed.select("parsed_id", "dataset", F.posexplode("candidate.entities").alias("pos", "entity")).select("parsed_id", F.col("pos").cast("bigint").alias("pos"), "dataset", F.col("entity.name").alias("name"))
    literal = checked_broadcast(refs.select("dataset", "name").distinct())
    typed = typed.join(literal, ["dataset", "name"], "left_anti")
    mapped = checked_broadcast(checkpoint(map_names(typed.select("dataset", "name"), refs)).withColumnsRenamed({"dataset": "d", "name": "n"}))
    return typed.join(mapped, F.col("dataset").eqNullSafe(F.col("d")) & F.col("name").eqNullSafe(F.col("n"))).select("parsed_id", "pos", "dataset", "name", "entity_ref")
