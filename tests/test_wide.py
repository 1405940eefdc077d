import datetime

import pytest

from tagloom.operators.wide import column_names, fit, widen
from tagloom.plans import queries
from tagloom.plans.queries import QUERIES
from tagloom.sources.tables import tag_rows

TAGS, TYPES = "kind string, idx bigint, pos int, k string, v string", "k string, col_name string, col_type string"
ALL = [("n", "n_int", "int"), ("d", "n_double", "double"), ("b", "n_bool", "boolean"), ("t", "n_date", "date"), ("s", "n_text", "text")]


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        (" 12 ", "int", 12), ("+5", "int", 5), ("-5", "int", -5), ("", "int", None), ("1.0", "int", None), ("1" * 18, "int", int("1" * 18)), ("1" * 19, "int", None), ("٣", "int", None), ("1\t", "int", None),
        ("1.5", "double", 1.5), (".5", "double", None), ("5.", "double", None), ("-3", "double", -3.0), ("1e3", "double", None), ("NaN", "double", None),
        ("YES", "boolean", True), ("False", "boolean", False), ("0", "boolean", False), ("maybe", "boolean", None),
        ("2024-02-29", "date", datetime.date(2024, 2, 29)), ("2023-02-29", "date", None), ("2024-2-9", "date", None), ("20240229", "date", None), (" x ", "text", " x "),
    ],
)
def test_fit(text, kind, value):
    assert fit(text, kind) == (value if kind != "text" else text.strip(" "))


def run(spark, tags, types=ALL, share=1.0):
    return {(r.kind, r.idx): r for r in widen(spark.createDataFrame(tags, TAGS), spark.createDataFrame(types, TYPES), share).collect()}


def test_values_issues_and_rest(spark):
    tags = [
        ("node", 1, 5, "n", "7"), ("node", 1, 2, "n", "x"), ("node", 1, 2, "n", "x"), ("node", 1, 9, "s", " a "), ("node", 1, 1, "odd", ""),
        ("way", 1, 0, "b", "Yes"), ("way", 1, 1, "t", "2020-01-01"), ("way", 1, 2, "d", "2.5"), ("way", 2, 0, None, "x"), ("way", 2, 1, "n", None), ("way", None, None, "n", "3"), ("way", None, 0, "n", "4"),
    ]
    out = run(spark, tags)
    one = out["node", 1]
    assert (one.n_int, one.n_text, one.other) == (None, " a ", {"odd": ""})
    assert {(i.k, i.issue, i.v) for i in one.issues} == {("n", "conflict", "7"), ("n", "unfit", "x")}
    way = out["way", 1]
    assert (way.n_bool, way.n_date, way.n_double, way.issues) == (True, datetime.date(2020, 1, 1), 2.5, [])
    assert out["way", 2].asDict() == {"kind": "way", "idx": 2, "n_int": None, "n_double": None, "n_bool": None, "n_date": None, "n_text": None, "other": {}, "issues": []}
    assert out["way", None].n_int == 4 and [(i.issue, i.v) for i in out["way", None].issues] == [("conflict", "3")]
    assert len(out) == 4


def test_ties_take_the_lowest_text(spark):
    out = run(spark, [("node", 1, 3, "s", "b"), ("node", 1, 3, "s", "a")])["node", 1]
    assert out.n_text == "a" and [(i.issue, i.v) for i in out.issues] == [("conflict", "b")]


def test_empty_tables(spark):
    assert run(spark, []) == {}
    out = run(spark, [("node", 1, 0, "n", "1")], types=[], share=None)
    assert out["node", 1].other == {"n": "1"}


def test_long_texts_and_odd_types(spark):
    out = run(spark, [("node", 1, 0, "q", "z" * 300_000)], types=[("q", "q_col", "colour"), (None, "a", "int"), ("r", None, "int")])
    assert len(out["node", 1].q_col) == 300_000


def test_frequent_keys_get_columns(spark):
    tags = [("node", i, 0, "a:b", str(i)) for i in range(20)] + [("node", 3, 1, "A_B", "x"), ("node", 4, 1, "rare", "y")]
    out = run(spark, tags, share=0.1)
    assert out["node", 3].k_a_b == "3" and out["node", 3].other == {"A_B": "x"} and out["node", 4].other == {"rare": "y"}


def test_column_names_differ_beyond_case():
    assert column_names(["a:b", "A_B", "ä", "ö"], {"kind"}) == ["k_a_b", "k_A_B_2", "k__", "k___2"]


def test_many_entities_cross_batches(spark):
    tags = [("node", i // 3, i % 3, ("n", "s", "z")[i % 3], str(i)) for i in range(45_000)]
    out = run(spark, tags, share=None)
    assert len(out) == 15_000
    assert all(r.n_int == 3 * i and r.n_text == str(3 * i + 1) and r.other == {"z": str(3 * i + 2)} for (_, i), r in out.items())


def test_further_columns(spark):
    df = spark.createDataFrame([("node", 1, 0, "n", "1", "x", 2)], TAGS + ", col_name string, c int")
    assert widen(df, spark.createDataFrame(ALL, TYPES), None).first().n_int == 1


def test_values_without_a_key_are_reported(spark):
    tags = [("way", 2, 0, None, "x"), ("way", 2, 5, None, "x"), ("way", 2, 1, None, ""), ("way", 2, 2, "n", "y"), ("way", 2, 3, "n", "1"), ("way", 3, 0, None, None), ("way", None, None, None, "z")]
    for share in (None, 1.0):
        df = widen(spark.createDataFrame(tags, TAGS), spark.createDataFrame(ALL, TYPES), share, report_keyless=True)
        out = {r.idx: {(i.k, i.issue, i.v) for i in r.issues} for r in df.collect()}
        assert out == {2: {(None, "no key", "x"), (None, "no key", ""), ("n", "unfit", "y"), ("n", "conflict", "1")}, 3: set(), None: {(None, "no key", "z")}}


def test_p6_wide_reports_values_without_a_key(spark, sf):
    wide = QUERIES["p6_wide"](spark, sf)
    got = {(r.kind, r.idx, i.v) for r in wide.collect() for i in r.issues if i.k is None and i.issue == "no key"}
    assert got == {(r.kind, r.idx, r.v) for r in tag_rows(spark, sf).where("k is null and v is not null").collect()} != set()


def test_p6_found_comes_from_the_whole_wide_table(spark, sf, monkeypatch):
    made = []
    monkeypatch.setattr(queries, "widen", lambda *a, **b: made.append(widen(*a, **b)) or made[-1])
    found, wide = queries.p6_found(spark, sf), queries.p6_wide(spark, sf)
    assert found.count() and made[0].columns == wide.columns
