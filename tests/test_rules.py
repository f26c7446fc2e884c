"""Check templates on passing, failing and null rows, and the cases where engines differ."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lattica.functions import documents, geo, text
from lattica.model.catalog import catalog, schema_of
from lattica.model.defs import Unique
from lattica.rules import keys, runner, templates


def test_catalogue_has_what_the_model_declares():
    tables = catalog().values()
    count = lambda f: sum(f(t) for t in tables)
    assert (len(tables), count(lambda t: len(t.columns)), count(lambda t: len(t.references)), count(lambda t: len(t.checks))) == (67, 530, 182, 105)
    actions = [r.action for t in tables for r in t.references]
    assert [actions.count(a) for a in "CRN"] == [44, 123, 15]
    assert count(lambda t: len(t.uniques)) == 26 and count(lambda t: sum(c.never_null for c in t.columns)) == 229
    kinds = [c.kind for t in tables for c in t.checks]
    assert {k: kinds.count(k) for k in set(kinds)} == {"enum": 33, "range": 27, "ordered": 17, "not_same": 9, "iff": 8, "regex": 5, "at_least_one": 4, "at_most_one": 1, "geometry_kind": 1}
    assert [t.name for t in tables if not t.complete] == ["analytics.analysis_input"]


def test_every_rule_of_the_catalogue_compiles_and_an_empty_table_breaks_none(spark):
    for table in catalog().values():
        rows = spark.createDataFrame([], schema_of(table))
        rules = runner.rules_of(table)
        if rules and table.name in ("core.resource", "field.census_measurement", "taxonomy.identification", "evidence.external_record_snapshot"):
            assert runner.report(rows, rules, table.name).filter("violations > 0").count() == 0
        else:
            rows.select(*rules.values()).schema


@pytest.mark.parametrize(
    ("rule", "values", "broken"),
    [
        (lambda: templates.enum("a", ["x", "y"]), ["x", "z", None], [False, True, False]),
        (lambda: templates.regex("a", r"^[A-Z0-9]{3}\z"), ["ABC", "ABC\n", "ab", None], [False, True, True, False]),
        (lambda: templates.too_long("a", 3), ["abc", "abcd", None], [False, True, False]),
        (lambda: templates.too_long("a", 2, exact=True), ["ab", "a", None], [False, True, False]),
        (lambda: templates.not_null("a"), ["x", None], [False, True]),
        (lambda: templates.not_same("a", F.lit("x")), ["y", "x", None], [False, True, False]),
    ],
)
def test_text_templates(spark, rule, values, broken):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, a string")
    assert [r["b"] for r in rows.withColumn("b", rule()).orderBy("i").collect()] == broken


def test_range_rounds_as_decimals_do(spark):
    rows = spark.createDataFrame([("0.9995",), ("1.001",), (None,)], "s string").withColumn("c", F.col("s").cast("decimal(4,3)"))
    assert [r[0] for r in rows.select(templates.in_range("c", 0, 1)).collect()] == [False, True, False]


def test_intervals_and_states(spark):
    d = date
    rows = spark.createDataFrame([(d(2020, 1, 1), d(2020, 1, 1)), (d(2020, 1, 2), d(2020, 1, 1)), (None, d(2020, 1, 1))], "f date, e date")
    assert [r[0] for r in rows.select(templates.ordered("f", "e")).collect()] == [False, True, False]
    states = spark.createDataFrame([("present", None), ("unknown", 1.0), ("present", 0.0), (None, 1.0)], "s string, v double")
    assert [r[0] for r in states.select(templates.iff(F.col("s") == "present", "v")).collect()] == [True, True, False, False]
    sets = spark.createDataFrame([("a", "b"), (None, None), ("a", None)], "p string, q string")
    assert [tuple(r) for r in sets.select(templates.at_most_one("p", "q"), templates.at_least_one("p", "q")).collect()] == [(True, False), (False, True), (False, False)]


def test_geometry_kind_in_either_byte_order(spark):
    little, big = bytes.fromhex("0101000000" + "00" * 16), bytes.fromhex("0000000001" + "00" * 16)
    flagged, mixed = bytes.fromhex("0101000020E6100000" + "00" * 16), bytes.fromhex("010700000000000000")
    rows = spark.createDataFrame([(0, bytearray(little)), (1, bytearray(big)), (2, bytearray(flagged)), (3, bytearray(mixed))], "i int, g binary").orderBy("i")
    assert [r[0] for r in rows.select(templates.geometry_kind("g", [1, 2, 3, 4, 5, 6])).collect()] == [False, False, False, True]
    assert [r[0] for r in rows.select(geo.wkb_srid(F.col("g"))).collect()] == [None, None, 4326, None]


def test_unique_keys_tell_nulls_apart(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), ("b", "r"), ("b", "r")], "k string, role string")
    assert [tuple(r) for r in keys.repeated(rows, {"k": F.col("k"), "role": F.col("role")}).collect()] == [("b", "r", 2)]
    dois = spark.createDataFrame([("10.1/A",), ("10.1/a",), (None,), (None,)], "doi string")
    assert [tuple(r) for r in keys.repeated_of(dois, Unique("t", ("lower(doi)",))).collect()] == [("10.1/a", 2)]
    preferred = spark.createDataFrame([(1, True), (1, True), (2, False), (2, False)], "t int, p boolean")
    assert [r["k0"] for r in keys.repeated_of(preferred, Unique("t", ("t",), "p")).collect()] == [1]


def test_parted_rows_are_the_input(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (2, "z")], "i int, a string")
    good, bad = runner.parted(rows, {"known": templates.enum("a", ["x"]), "small": templates.in_range("i", 0, 1)})
    assert sorted((r["i"], r["broken_rules"]) for r in bad.collect()) == [(2, ["known", "small"]), (2, ["known", "small"]), (3, ["small"])]
    assert good.count() + bad.count() == rows.count()


def test_defaults_leave_nulls_alone(spark):
    rows = spark.createDataFrame([(None,)], "a string")
    assert [tuple(r) for r in runner.filled(rows, {"a": F.lit("d"), "b": F.lit(1)}).collect()] == [(None, 1)]


def test_json_comparison(spark):
    rows = spark.createDataFrame([('{"b":1,"a":2}', '{"a":2,"b":1}'), ('{"a":1,"a":2}', '{"a":2}'), ('{"a":1.0}', '{"a":1}'), ('{"a":1}', None), (None, None)], "x string, y string")
    assert [r[0] for r in rows.select(documents.changed(F.col("x"), F.col("y"))).collect()] == [False, False, False, True, False]
    a, b = spark.createDataFrame([(1, "x", None)], "id int, p string, q string"), spark.createDataFrame([(1, "x", "n")], "id int, p string, q string")
    assert [tuple(r) for r in documents.differences(a, b, "id", ["p", "q"]).collect()] == [(1, "q", None, "n")]


def test_trigram_similarity(spark):
    row = spark.range(1).select(text.similarity(text.trigrams(F.lit("word")), text.trigrams(F.lit("two words"))).alias("s")).first()
    assert abs(row["s"] - 0.363636) < 1e-5
