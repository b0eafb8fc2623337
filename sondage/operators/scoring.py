"""Scores of candidate models against reference models (JN6-JN11, SC2-SC9, SF11, AG20).

Candidate and reference stand in one row; matching is a fold over arrays, in declaration order, first come first served.
The reference table is joined by dataset (broadcast after a check of its size).

Defined results: a candidate without entities scores 0 everywhere; an empty reference gives only false positives; divisions
by nothing are 0. Precision, recall and F1 are unrounded; ``rounded`` gives four digits, half to even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.text import canon, multiplicity, relation_class, unordered_pair
from sondage.session import checked_broadcast


def prf(tp: Column, fp: Column, fn: Column) -> Column:
    """SF11: counts with unrounded precision, recall and F1, 0 where undefined."""
    p = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return F.struct(tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"), fn.cast("bigint").alias("fn"), p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def rounded(value: Column, digits: int = 4) -> Column:
    return F.bround(value, digits)


def first_claims(wanted: Column, offered: Column) -> Column:
    """For each key of ``wanted`` in order, the place of the first unclaimed set of ``offered`` that holds it, or -1."""

    def claim(state: Column, key: Column) -> Column:
        places = F.transform(offered, lambda s, i: F.when(F.array_contains(s, key) & ~F.array_contains(state, i), i))
        return F.concat(state, F.array(F.coalesce(F.get(F.filter(places, lambda x: x.isNotNull()), F.lit(0)), F.lit(-1))))

    return F.aggregate(wanted, F.array().cast("array<int>"), claim)


def first_fits(wanted: Column, offered: Column) -> Column:
    """For each set of ``wanted`` in order, the place of the first unclaimed name of ``offered`` that it holds, or -1."""

    def claim(state: Column, names: Column) -> Column:
        places = F.transform(offered, lambda x, i: F.when(F.array_contains(names, x) & ~F.array_contains(state, i), i))
        return F.concat(state, F.array(F.coalesce(F.get(F.filter(places, lambda x: x.isNotNull()), F.lit(0)), F.lit(-1))))

    return F.aggregate(wanted, F.array().cast("array<int>"), claim)


def references(entities: DataFrame) -> DataFrame:
    """SC2, SC3: (dataset, reference) from rows (dataset, entity_ref, name, aliases, primary_key, attributes(name, semantic_type)).

    Two more columns may stand there: ``candidate_keys`` (array<array<string>>), other keys that are accepted, and
    ``attribute_aliases`` (map<string, array<string>>), other names of an attribute, which count in keys too.
    """
    has = set(entities.columns)
    alternates = F.coalesce("candidate_keys", F.array().cast("array<array<string>>")) if "candidate_keys" in has else F.array().cast("array<array<string>>")
    no_names = F.array().cast("array<string>")

    def also(name: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col("attribute_aliases"), name), no_names) if "attribute_aliases" in has else no_names

    def accepted(column: Column) -> Column:
        """The names accepted for a key's column: those of the attribute of the same canonical name."""
        same = F.filter("attributes", lambda a: canon(a["name"]) == canon(column))
        return F.array_distinct(F.concat(F.array(canon(column)), F.transform(F.coalesce(also(F.get(same, F.lit(0))["name"]), no_names), canon)))

    names = F.array_distinct(F.concat(F.array(canon(F.col("name"))), F.transform(F.coalesce("aliases", no_names), canon)))
    attrs = F.transform("attributes", lambda a: F.struct(F.array_distinct(F.concat(F.array(canon(a["name"])), F.transform(also(a["name"]), canon))).alias("names"), F.coalesce(a["semantic_type"] == "ForeignKey", F.lit(False)).alias("is_fk")))
    keys = F.transform(F.concat(F.array("primary_key"), alternates), lambda key: F.transform(key, accepted))
    entity = F.struct(F.col("entity_ref").alias("no"), names.alias("names"), canon(F.col("name")).alias("key"), keys.alias("keys"), attrs.alias("attrs"))
    return entities.select("dataset", entity.alias("e")).groupBy("dataset").agg(F.array_sort(F.collect_list("e")).alias("reference"))


def key_fits(given: Column, keys: Column) -> Column:
    """JN9: whether the given columns (canonical names) are one of the keys, column by column and each once."""
    return (F.size(given) > 0) & F.exists(keys, lambda key: (F.size(key) == F.size(given)) & ~F.array_contains(first_fits(key, given), -1))


def _canonical(runs: DataFrame) -> DataFrame:
    """``runs`` with ``_own``: each candidate entity's canonical names, of itself, its key and its attributes, computed once."""
    attrs = lambda e: F.transform(e["attrs"], lambda a: F.struct(canon(a["name"]).alias("key"), a["is_fk"].alias("is_fk")))
    return runs.withColumn("_own", F.transform("candidate.entities", lambda e: F.struct(canon(e["name"]).alias("key"), F.transform(e["pk"], canon).alias("pk"), attrs(e).alias("attrs"))))


def _counts(reference: Column, claims: Column, chosen: bool) -> Column:
    """True positives, false positives and misses over the attributes that are references (``chosen``) or aren't."""
    mine = F.transform("_own", lambda e: F.transform(F.filter(e["attrs"], lambda a: a["is_fk"] == chosen), lambda a: a["key"]))
    theirs = F.transform(reference, lambda e: F.transform(F.filter(e["attrs"], lambda a: a["is_fk"] == chosen), lambda a: a["names"]))
    empty = F.array().cast("array<array<string>>")
    # What an entity can match is looked up before the fold over its attributes, in which it would be looked up for each.
    pairs = F.zip_with(mine, claims, lambda keys, at: F.struct(keys.alias("keys"), F.when(at >= 0, F.get(theirs, at)).otherwise(empty).alias("offered")))
    hits = F.transform(pairs, lambda p: F.size(F.filter(first_claims(p["keys"], p["offered"]), lambda x: x >= 0)))
    total = lambda sizes: F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    return F.struct(total(hits).alias("tp"), total(F.transform(mine, F.size)).alias("given"), total(F.transform(theirs, F.size)).alias("wanted"))


def score_models(runs: DataFrame, reference: DataFrame) -> DataFrame:
    """SC4, SC6-SC8: ``runs`` (dataset, candidate, ...) with the scores of entities, keys and attributes as ``scores``."""
    joined = _canonical(runs.join(checked_broadcast(reference), "dataset"))
    ref = F.col("reference")
    step = joined.withColumn("_claims", first_claims(F.transform("_own", lambda e: e["key"]), F.transform(ref, lambda e: e["names"])))
    matched = F.size(F.filter("_claims", lambda x: x >= 0))
    entities = prf(matched, F.size("_own") - matched, F.size(ref) - matched)
    right = F.zip_with("_own", F.col("_claims"), lambda e, at: F.when(at >= 0, key_fits(e["pk"], F.get(ref, at)["keys"])))
    pk_given = F.size(F.filter("_own", lambda e: F.size(e["pk"]) > 0))
    step = step.withColumn("_fk", _counts(ref, F.col("_claims"), True)).withColumn("_plain", _counts(ref, F.col("_claims"), False))
    step = step.withColumn("_pk", F.size(F.filter(right, lambda x: F.coalesce(x, F.lit(False)))))
    fk, plain, pk = F.col("_fk"), F.col("_plain"), F.col("_pk")
    over = lambda c: c["given"] - c["tp"]
    under = lambda c: c["wanted"] - c["tp"]
    scores = F.struct(
        entities.alias("entities"),
        prf(pk + fk["tp"], pk_given - pk + over(fk), F.size(ref) - pk + under(fk)).alias("keys"),
        prf(pk, pk_given - pk, F.size(ref) - pk).alias("pk_only"),
        prf(fk["tp"], over(fk), under(fk)).alias("fk_only"),
        prf(plain["tp"], over(plain), under(plain)).alias("attributes"),
    )
    return step.withColumn("scores", scores).drop("_own", "_claims", "_fk", "_plain", "_pk", "reference")


def score_relationships(runs: DataFrame, reference: DataFrame, links: DataFrame) -> DataFrame:
    """SC5, SC9, JN10, JN11: ``runs`` with ``relationships`` (strict) and ``relaxed_recall`` against ``links``.

    links: (dataset, links array<struct<parent, child, klass, fk_cols>>) with canonical names.
    """
    joined = runs.join(checked_broadcast(reference), "dataset").join(checked_broadcast(links), "dataset")
    candidate, ref = F.col("candidate.entities"), F.col("reference")
    names = F.transform(candidate, lambda e: canon(e["name"]))
    step = joined.withColumn("_names", names).withColumn("_claims", first_claims(F.col("_names"), F.transform(ref, lambda e: e["names"])))

    def meant(end: Column) -> Column:
        """The reference name of a relationship's end; null if its entity isn't matched or wasn't declared."""
        at = F.get(F.col("_claims"), F.array_position(F.col("_names"), end).cast("int") - 1)
        return F.when(at >= 0, F.get(ref, at)["key"])

    # The canonical names first, a column each: in one expression they would be computed wherever they are named.
    step = step.withColumn("_rels", F.transform("candidate.relationships", lambda r: F.struct(canon(r["to"]).alias("to"), canon(r["frm"]).alias("frm"), r["cf"].alias("cf"), r["ct"].alias("ct"), r["fk"].alias("fk"))))
    ends = F.transform("_rels", lambda r: F.struct(meant(r["to"]).alias("parent"), meant(r["frm"]).alias("child"), relation_class(multiplicity(r["ct"]), multiplicity(r["cf"])).alias("klass"), canon(r["fk"]).alias("fk")))
    step = step.withColumn("_ends", ends)

    def claim(state: Column, r: Column) -> Column:
        def free(test) -> Column:
            fits = F.transform("links", lambda g, i: F.when((g["parent"] == r["parent"]) & (g["child"] == r["child"]) & (g["klass"] == r["klass"]) & ~F.array_contains(state, i) & test(g), i))
            return F.get(F.filter(fits, lambda x: x.isNotNull()), F.lit(0))

        named = free(lambda g: (r["fk"] != "") & F.array_contains(g["fk_cols"], r["fk"]))
        return F.concat(state, F.array(F.coalesce(named, free(lambda g: F.lit(True)), F.lit(-1))))

    step = step.withColumn("_picked", F.aggregate("_ends", F.array().cast("array<int>"), claim))
    tp = F.size(F.filter("_picked", lambda x: x >= 0))
    wanted = F.array_distinct(F.transform("links", lambda g: unordered_pair(g["parent"], g["child"])))
    got = F.array_distinct(F.transform(F.filter("_ends", lambda r: r["parent"].isNotNull() & r["child"].isNotNull()), lambda r: unordered_pair(r["parent"], r["child"])))
    relaxed = F.coalesce(F.try_divide(F.size(F.array_intersect(wanted, got)).cast("double"), F.size(wanted).cast("double")), F.lit(0.0))
    return step.withColumn("relationships", prf(tp, F.size("_ends") - tp, F.size("links") - tp)).withColumn("relaxed_recall", relaxed).drop("_names", "_claims", "_rels", "_ends", "_picked", "links", "reference")


def evaluate(runs: DataFrame, reference: DataFrame, links: DataFrame) -> DataFrame:
    """SC8, SC10: ``runs`` with ``metrics``, the four blocks of scores as the records have them, rounded to four digits."""
    scored = score_relationships(score_models(runs, reference), reference, links)

    def block(part: Column, *more: Column) -> Column:
        return F.struct(*[part[c].alias(c) for c in ("tp", "fp", "fn")], *[rounded(part[c]).alias(c) for c in ("precision", "recall", "f1")], *more)

    found = F.col("scores")
    metrics = F.struct(
        block(found["entities"]).alias("entities"),
        block(F.col("relationships")).alias("relationships"),
        block(found["keys"], block(found["pk_only"]).alias("pk_only"), block(found["fk_only"]).alias("fk_only")).alias("keys"),
        block(found["attributes"]).alias("attributes"),
    )
    return scored.withColumn("metrics", metrics).drop("scores", "relationships", "relaxed_recall")
