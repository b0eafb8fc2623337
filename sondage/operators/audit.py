"""Audit of a table against a reference model through a binding (PF4-PF7, PF9, CP7, SNK10, PRJ5, ST1, ST2, ST8, JN5, JN16, SO7): one table of findings.

The model and the binding are metadata that the schema bounds; they are read on the driver to make the plan, the data never are.

Defined results: an entity without binding gives one finding and no further checks; keys that not all projections of an entity
map are skipped; a null is a value of its own in keys and dependencies and refers to nothing in references.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.operators.dependencies import artifacts, closure
from sondage.operators.integrity import dangling, projection, stack
from sondage.operators.profile import fd_violations, single_fds, unique_combinations

FINDING = "check string, subject string, status string, detail bigint"


@dataclass(frozen=True)
class Entity:
    """An entity of the model: its attributes, its key, other accepted keys, and its projections (attribute -> column), one a role."""

    name: str
    attributes: tuple[str, ...]
    key: tuple[str, ...]
    others: tuple[tuple[str, ...], ...] = ()
    projections: tuple[dict[str, str], ...] = ()

    @property
    def common(self) -> list[str]:
        """PRJ5: the attributes that all projections map, in the model's order."""
        return [a for a in self.attributes if self.projections and all(a in p for p in self.projections)]

    @property
    def keys(self) -> list[tuple[str, ...]]:
        """ST8: the accepted keys that all projections map."""
        return [k for k in (self.key, *self.others) if k and set(k) <= set(self.common)]


@dataclass(frozen=True)
class Reference:
    """A reference of a child's attributes to a parent's."""

    name: str
    child: str
    child_attributes: tuple[str, ...]
    parent: str
    parent_attributes: tuple[str, ...]


@dataclass
class Model:
    entities: list[Entity]
    references: list[Reference] = field(default_factory=list)

    def expected(self) -> set[tuple[str, str]]:
        """PF7: the dependencies between columns that single-column keys imply."""
        return {
            (p[k[0]], column)
            for e in self.entities
            for p in e.projections
            for k in (e.key, *e.others)
            if len(k) == 1 and k[0] in p
            for column in p.values()
            if column != p[k[0]]
        }


def grounding(df: DataFrame, model: Model) -> DataFrame:
    """JN16, ST6: is every entity bound, does every bound column exist, is every attribute mapped?"""
    columns, rows = set(df.columns), []
    for e in model.entities:
        rows.append(("bound", e.name, "OK" if e.projections else "FAIL", len(e.projections)))
        for i, p in enumerate(e.projections):
            unknown, unmapped = set(p.values()) - columns, set(e.attributes) - set(p)
            rows += [("columns exist", f"{e.name} {i}", "FAIL" if unknown else "OK", len(unknown)), ("attributes mapped", f"{e.name} {i}", "FAIL" if unmapped else "OK", len(unmapped))]
    return df.sparkSession.createDataFrame(rows, FINDING)


def _finding(check: str, subject: str, lost: DataFrame, bad: str = "FAIL") -> DataFrame:
    """One row: OK if ``lost`` is empty, and how many rows it has."""
    return lost.agg(F.count("*").alias("detail")).select(F.lit(check).alias("check"), F.lit(subject).alias("subject"), F.when(F.col("detail") == 0, "OK").otherwise(bad).alias("status"), "detail")


def key_checks(df: DataFrame, entity: Entity) -> list[DataFrame]:
    """PF4, PF5: does each accepted key determine the other common attributes, over all roles together?"""
    if not entity.keys:
        return []
    rows = stack([projection(df, {a: p[a] for a in entity.common}) for p in entity.projections])
    rest = lambda key: [a for a in entity.common if a not in key]
    return [_finding("key determines", f"{entity.name} ({', '.join(key)})", fd_violations(rows, list(key), rest(key)) if rest(key) else rows.limit(0)) for key in entity.keys]


def accidental_keys(df: DataFrame, entity: Entity) -> DataFrame | None:
    """PF6: unique attributes (FAIL) and pairs of attributes (WARN) of the entity's instances that contain no accepted key."""
    if not entity.common:
        return None
    instances = stack([projection(df, {a: p[a] for a in entity.common}) for p in entity.projections]).distinct()
    found = unique_combinations(instances, sorted(entity.common), 2, [list(k) for k in (entity.key, *entity.others) if k]).where("is_unique")
    return found.select(F.lit("accidental key").alias("check"), F.concat(F.lit(f"{entity.name} ("), "columns", F.lit(")")).alias("subject"), F.when(F.col("size") == 1, "FAIL").otherwise("WARN").alias("status"), F.col("rows").alias("detail"))


def references(df: DataFrame, model: Model) -> list[DataFrame]:
    """JN5, ST3: values of a child's reference that no role of the parent has."""
    by_name, out = {e.name: e for e in model.entities}, []
    for r in model.references:
        child, parent = by_name[r.child], by_name[r.parent]
        sides = [[projection(df, {f"k{i}": p[a] for i, a in enumerate(names)}) for p in e.projections if set(names) <= set(p)] for e, names in ((child, r.child_attributes), (parent, r.parent_attributes))]
        if all(sides):
            out.append(_finding("reference", f"{r.name}: {r.child} -> {r.parent}", dangling(stack(sides[0]), stack(sides[1]), {f"k{i}": f"k{i}" for i in range(len(r.child_attributes))})))
    return out


def dependency_artifacts(df: DataFrame, model: Model, order: str | None = None) -> DataFrame:
    """PF9, SO7: dependencies between columns that the model doesn't imply and whose values don't contain each other, sorted: a warning each."""
    columns = sorted({c for e in model.entities for p in e.projections for c in p.values() if c in df.columns})
    expected = closure(df.sparkSession.createDataFrame(sorted(model.expected()), "lhs string, rhs string"))
    found = artifacts(df, single_fds(df, columns), expected, order=order)
    return found.orderBy("lhs", "rhs").select(F.lit("dependency artifact").alias("check"), F.concat("lhs", F.lit(" -> "), "rhs").alias("subject"), F.lit("WARN").alias("status"), F.lit(1).cast("bigint").alias("detail"))


def audit(df: DataFrame, model: Model, order: str | None = None) -> DataFrame:
    """CP7, SNK10: all findings; the audit fails if any has the status FAIL."""
    parts = [grounding(df, model)]
    for e in model.entities:
        known = all(set(p.values()) <= set(df.columns) for p in e.projections)
        if e.projections and known:
            parts += [*key_checks(df, e), *([accidental] if (accidental := accidental_keys(df, e)) is not None else [])]
    if all(set(p.values()) <= set(df.columns) for e in model.entities for p in e.projections):
        parts += [dependency_artifacts(df, model, order), *references(df, model)]
    return stack(parts)
