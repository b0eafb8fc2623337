"""Rows that fail to parse: an error-recovering recursive-descent reader of delimited records.

The grammar, one method a rule:

    file   := record (eol record)*
    record := field (',' field)*
    field  := quoted | plain
    quoted := '"' ( any character but '"' | '""' )* '"'
    plain  := any characters but ',' '"' CR LF

A quote that breaks the grammar is noted with its place, and reading resumes at the next anchor: the start of a line
that begins with a valid record start (the contract's ``anchor``). Without one the rest of the text is given up.

Defined results: a null text is one record without fields (``columns``), an empty text one record with one empty field
(``columns`` unless the contract has one field). Extra columns of the input are not carried along, so names can't clash.
Texts of any length are read in one pass, in time linear in their length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.session import spread

QUOTED = re.compile(r'"((?:[^"]|"")*+)"')
PLAIN = re.compile(r'[^,"\r\n]*+')
LINE_END = re.compile(r"\r\n|\r|\n")


@dataclass(frozen=True)
class Contract:
    """What a record must be: its fields' names with a pattern and optional further test, and how a record starts."""

    fields: tuple[tuple[str, str], ...]
    anchor: str
    tests: dict[str, Callable[[str], bool]] = field(default_factory=dict)


@dataclass
class Record:
    start: int
    end: int = 0
    values: list[str] = field(default_factory=list)


@dataclass
class Fault:
    reason: str
    offset: int
    place: int  # the field's number in its record, from 0


class Reader:
    """Recursive descent over one text; ``records`` and ``faults`` hold the outcome."""

    def __init__(self, text: str, anchor: re.Pattern) -> None:
        self.text, self.at, self.anchor = text, 0, anchor
        self.records: list[Record] = []
        self.faults: list[Fault] = []

    def file(self) -> Reader:
        while self.record() and (end := LINE_END.match(self.text, self.at)):
            self.faults.append(Fault("columns", self.at, len(self.records[-1].values) if self.records else 0))
            self.at = end.end()
        return self

    def record(self) -> bool:
        """Reads one record; False if nothing is left to read."""
        self.records.append(record := Record(self.at))
        while self.field(record):
            if self.text[self.at : self.at + 1] != ",":
                record.end = self.at
                return self.at < len(self.text)
            self.at += 1
        record.end = self.at
        self.records.pop()  # broken: it isn't a record
        return self.resume()

    def field(self, record: Record) -> bool:
        return self.quoted(record) if self.text[self.at : self.at + 1] == '"' else self.plain(record)

    def quoted(self, record: Record) -> bool:
        found = QUOTED.match(self.text, self.at)
        if found is None:
            return self.broken(record, self.at)
        self.at = found.end()
        if self.text[self.at : self.at + 1] not in ("", ",", "\r", "\n"):
            return self.broken(record, self.at)
        record.values.append(found[1].replace('""', '"'))
        return True

    def plain(self, record: Record) -> bool:
        found = PLAIN.match(self.text, self.at)
        self.at = found.end()
        if self.text[self.at : self.at + 1] == '"':
            return self.broken(record, self.at)
        record.values.append(found[0])
        return True

    def broken(self, record: Record, offset: int) -> bool:
        self.faults.append(Fault("quoting", offset, len(record.values)))
        self.at = offset
        return False

    def resume(self) -> bool:
        """Moves to the line end before the next validated record start."""
        found = self.anchor.search(self.text, self.at)
        self.at = found.start() if found else len(self.text)
        return found is not None


def _judge(contract: Contract) -> Callable[[str | None], tuple]:
    anchor = re.compile(rf"(?:\r\n|\r|\n)(?={contract.anchor})")
    patterns = [(name, re.compile(pattern), contract.tests.get(name)) for name, pattern in contract.fields]
    rank = {"quoting": 0, "columns": 1, "value": 2}

    def values(record: Record) -> Fault | None:
        if len(record.values) != len(patterns):
            return Fault("columns", record.end, len(record.values))
        for place, (value, (_, pattern, test)) in enumerate(zip(record.values, patterns, strict=True)):
            if not pattern.fullmatch(value) or test and not test(value):
                return Fault("value", record.start, place)
        return None

    def judge(text: str | None) -> tuple:
        if text is None:
            return "columns", 0, 1, 1, 0, 0, []
        reader = Reader(text, anchor).file()
        faults = [*reader.faults]
        good = []
        for record in reader.records:
            found = values(record)
            if found:
                faults.append(found)
            else:
                good.append(record.values)
        if not faults:
            return None, None, None, None, None, 1, good
        first = min(faults, key=lambda f: (rank[f.reason], f.offset))
        before = text[: first.offset]
        breaks = [m.end() for m in LINE_END.finditer(before)]
        return first.reason, first.offset, len(breaks) + 1, first.offset - (breaks[-1] if breaks else 0) + 1, first.place, len(good), good

    return judge


def parse_records(df: DataFrame, key: str, text: str, contract: Contract, recovered: bool = False) -> DataFrame:
    """One row a row of ``df``: ``key``, then either the contract's fields or the first fault that applies.

    reason: null for a valid row, else quoting, columns or value (the first in this order that occurs in the row).
    at, line, col, place: where the fault is (character from 0, line and column from 1, field from 0).
    recovered: valid records found in the text, counting those after a broken one. Where ``recovered`` is asked for, these come out
    too, a row each without a reason, and ``part`` numbers them from 1; it is 0 for the row itself.
    """
    names = [name for name, _ in contract.fields]
    judge = _judge(contract)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [judge(value) for value in batch.column(1).to_pylist()]
            rows = [(i, 0, x[:6], x[6][0] if x[0] is None else None) for i, x in enumerate(out)]
            if recovered:
                rows += [(i, part, (None, None, None, None, None, 1), own) for i, x in enumerate(out) if x[0] is not None for part, own in enumerate(x[6], 1)]
            columns = [batch.column(0).take(pa.array([i for i, *_ in rows], pa.int64())), pa.array([x[0] for *_, x, _ in rows], pa.string())]
            columns += [pa.array([x[i] for *_, x, _ in rows], pa.int32()) for i in range(1, 6)] + [pa.array([part for _, part, *_ in rows], pa.int32())]
            columns += [pa.array([own and own[i] for *_, own in rows], pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, [key, "reason", "at", "line", "col", "place", "recovered", "part", *names])

    schema = f"`{key}` {kind.simpleString()}, reason string, at int, line int, col int, place int, recovered int, part int, " + ", ".join(f"`{n}` string" for n in names)
    return spread(df.select(F.col(f"`{key}`"), F.col(f"`{text}`"))).mapInArrow(run, schema)


# The finish reasons that the export's contract allows.
FINISH_REASONS = ("STOP", "MAX_TOKENS", "SAFETY", "OTHER", "stop", "length", "content_filter", "error", "end_turn", "max_tokens", "refusal", "eos")


def export_contract(datasets: list[str]) -> Contract:
    """The contract of the run export; ``datasets`` are the names a row may carry (a bounded list of the reference table)."""
    names = "|".join(map(re.escape, sorted(datasets))) or r"(?!)"
    cond = r"k[01]{3}__h[mcn]"
    run = rf"(?:{names})__[a-z]+__{cond}__t[0-9]{{2}}__p[0-9]+"
    return Contract(
        fields=(
            ("run_id", run),
            ("provider", r"[a-z]+"),
            ("dataset", names),
            ("cond_id", cond),
            ("temperature", r"[0-9]+(?:\.[0-9]+)?"),
            ("replicate", r"[1-9][0-9]{0,8}"),
            ("parse_failure", r"true|false"),
            ("latency_ms", r"[0-9]{0,9}"),
            ("finish_reason", "|".join(FINISH_REASONS) + "|"),
            ("response_text", r"[^�\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]*"),
        ),
        anchor=rf'"?{run}"?,"?[a-z]+"?,',
        tests={"temperature": lambda v: float(v) <= 2},
    )


def typed_export(rows: DataFrame) -> DataFrame:
    """The valid rows of parse_records under export_contract, with types."""
    return rows.filter("reason is null").select(
        "row_id",
        "part",
        "run_id",
        "provider",
        "dataset",
        "cond_id",
        F.col("temperature").cast("double").alias("temperature"),
        F.col("replicate").cast("bigint").alias("replicate"),
        (F.col("parse_failure") == "true").alias("parse_failure"),
        F.expr("try_cast(latency_ms as bigint)").alias("latency_ms"),
        F.nullif(F.col("finish_reason"), F.lit("")).alias("finish_reason"),
        "response_text",
    )
