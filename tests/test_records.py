import random

import pytest

from sondage.operators.records import export_contract, parse_records, typed_export

GOOD = 'clinic__ardent__k101__hm__t05__p1,ardent,clinic,k101__hm,0.5,3,false,120,stop,"a ""b"",\nc"'
DATASETS = ["clinic", "library"]


def reasons(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, row_text string")
    return {r.row_id: r for r in parse_records(df, "row_id", "row_text", export_contract(DATASETS)).collect()}


@pytest.mark.parametrize(
    "text,reason",
    [
        (GOOD, None),
        (GOOD.replace(',"a', ',x"a'), "quoting"),
        (GOOD + "x", "quoting"),
        (GOOD[:-1], "quoting"),
        (GOOD + "\n", "columns"),
        (GOOD + ",", "columns"),
        ("", "columns"),
        (None, "columns"),
        ("a;b;c", "columns"),
        (GOOD.replace("false", "no"), "value"),
        (GOOD.replace(",0.5,", ",2.01,"), "value"),
        (GOOD.replace(",0.5,", ",٠.5,"), "value"),
        (GOOD.replace(",3,", ",03,"), "value"),
        (GOOD.replace("stop", "Stop"), "value"),
        (GOOD.replace(",clinic,", ",museum,"), "value"),
        (GOOD.replace("\nc", "\x01c"), "value"),
        (GOOD.replace("\nc", "\tc"), None),
        (GOOD.replace(",120,", ",,"), None),
        (GOOD.replace(",ardent,", ',"ardent",'), None),
        (GOOD.replace("\nc", "x" * 200_000), None),
    ],
)
def test_reasons(spark, text, reason):
    assert reasons(spark, [text])[0].reason == reason


def test_recovers_at_the_next_record(spark):
    row = reasons(spark, [GOOD.replace(',"a', ',x"a') + "\n" + GOOD])[0]
    assert (row.reason, row.recovered, row.line, row.place) == ("quoting", 1, 1, 9)


def test_recovered_records_are_returned(spark):
    df = spark.createDataFrame([(1, GOOD.replace(',"a', ',x"a') + "\n" + GOOD + "\n" + GOOD), (2, GOOD), (3, None)], "row_id long, row_text string")
    rows = typed_export(parse_records(df, "row_id", "row_text", export_contract(DATASETS), True)).collect()
    assert sorted((r.row_id, r.part, r.replicate) for r in rows) == [(1, 1, 3), (1, 2, 3), (2, 0, 3)]


def test_typed_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, GOOD)], "row_id long, row_text string")
    row = typed_export(parse_records(df, "row_id", "row_text", export_contract(DATASETS))).first()
    assert (row.temperature, row.replicate, row.parse_failure, row.latency_ms, row.response_text) == (0.5, 3, False, 120, 'a "b",\nc')
    assert parse_records(df.limit(0), "row_id", "row_text", export_contract(DATASETS)).count() == 0


def test_against_a_character_automaton(spark):
    """A state machine over characters, written apart from the grammar, must agree on quoting and columns."""

    def slow(text):
        state, fields, breaks = "start", 1, False
        for c in text:
            if state == "quoted":
                state = "closing" if c == '"' else state
            elif state == "closing" and c == '"':
                state = "quoted"
            elif c == ",":
                fields, state = fields + 1, "start"
            elif c in "\r\n":
                breaks, state = True, "start"
            elif c == '"' and state == "start":
                state = "quoted"
            elif c == '"' or state == "closing":
                return "quoting"
            else:
                state = "plain"
        return "quoting" if state == "quoted" else "columns" if breaks or fields != 10 else "other"

    rng = random.Random(5)
    texts = ["".join(rng.choice('a",,\n"') for _ in range(rng.randint(0, 24))) for _ in range(500)]
    for i, row in reasons(spark, texts).items():
        assert (row.reason if row.reason in ("quoting", "columns") else "other") == slow(texts[i]), texts[i]
