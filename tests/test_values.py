"""Column expressions, cell by cell."""

import pytest
from pyspark.sql import functions as F

from tessella.errors import SpecError
from tessella.functions.hashing import digest, digest_column, masked, masked_column
from tessella.functions.predicates import check, compiled
from tessella.functions.values import moment, normalize, number


def cell(spark, value, make):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "chain", "wanted"), [("\t x \n", ["trim"], "x"), (" x ", [], "x"), (" ", ["empty_to_null"], None), ("000", ["strip_leading_zeros"], "0"), ("-007", ["strip_leading_zeros"], "-7"), ("+7", ["strip_leading_zeros"], "+7"), ("01.0", ["strip_leading_zeros"], "01.0"), (" aß", ["trim", "uppercase"], "ASS"), (None, ["trim"], None)])
def test_normalizers(spark, value, chain, wanted):
    assert cell(spark, value, lambda c: normalize(c, chain)) == wanted


@pytest.mark.parametrize(("value", "wanted"), [("1,000.5", "1000.5000000000"), ("", "0E-10"), (None, "0E-10"), ("x", None), ("1e3", "1000.0000000000")])
def test_numbers(spark, value, wanted):
    got = cell(spark, value, number)
    assert (got if got is None else str(got)) == wanted


@pytest.mark.parametrize(("value", "given"), [("2026", False), ("2026-01-02", True), ("2026-01-02T08:00:00Z", True), ("x", False)])
def test_moments(spark, value, given):
    assert (cell(spark, value, moment) is not None) is given


@pytest.mark.parametrize(
    ("value", "predicate", "wanted"),
    [
        (None, {"op": "eq", "value": None}, True),
        (None, {"op": "ne", "value": "a"}, True),
        (None, {"op": "not_in", "value": ["a"]}, True),
        (None, {"op": "in", "value": ["a", None]}, True),
        (None, {"op": "contains", "value": "a"}, False),
        (None, {"op": "gt", "value": 1}, False),
        (" ", {"op": "is_null"}, True),
        ("9", {"op": "lt", "value": 10}, True),
        ("b", {"op": "gt", "value": "a"}, True),
        ("2024-02-01", {"op": "gte", "value": "2024-01-31"}, True),
        ("abc", {"op": "starts_with", "value": "ab"}, True),
        ("A ", {"op": "eq", "value": "a", "normalize": ["trim", "lowercase"]}, True),
    ],
)
def test_predicates(spark, value, predicate, wanted):
    p = {"field": "c", **predicate}
    check(p, "p")
    assert cell(spark, value, lambda c: compiled(p, lambda _: c)) is wanted
    assert cell(spark, value, lambda c: compiled({"not": p}, lambda _: c)) is (not wanted)


@pytest.mark.parametrize("p", [{}, {"op": "eq"}, {"field": "a", "op": "like", "value": 1}, {"field": "a"}, {"field": "a", "op": "in", "value": "x"}, {"all": []}, {"all": [{"field": "a", "value": 1}], "any": []}, {"field": "a", "value": 1, "normalize": ["shout"]}])
def test_malformed_predicates(p):
    with pytest.raises(SpecError):
        check(p, "p")


def test_hashes_agree_inside_and_outside_of_plans(spark):
    assert cell(spark, "x", lambda c: digest_column(F.struct(c.alias("a"), F.lit("é").alias("b")))) == digest({"b": "é", "a": "x"})
    assert cell(spark, 'q"é', lambda c: masked_column(c, "hash")) == masked('q"é', "hash")


def test_strip_is_that_of_text(spark):
    every = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    frame = spark.createDataFrame([(f"{c}x{c}",) for c in every], "c string").select(normalize(F.col("c"), ["trim"]).alias("x"))
    assert [r["x"] for r in frame.collect()] == [f"{c}x{c}".strip() for c in every]
