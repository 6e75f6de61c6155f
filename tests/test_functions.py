"""Scalar tables: spellings and the values they stand for."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import numbers, similarity, text


def each(spark, values, column):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["x"] for r in rows.select("k", column(F.col("v")).alias("x")).orderBy("k").collect()]


def test_numbers(spark):
    table = {"1.234.567,89": 1234567.89, "1,234,567.89": 1234567.89, "1 234 567": 1234567, "(1.000)": -1000, "-0.5": -0.5, "1.500.000 VNĐ": 1500000, "1.234": 1234, "12.000": 12000, "1,234": 1234, "0,5": 0.5, "12,75": 12.75, "lung tung": None, "abc123": None, "N/A": None, "-": None, "": None}
    assert each(spark, list(table), numbers.parse_number) == list(table.values())
    assert each(spark, [None], numbers.parse_number) == [None]


def test_units(spark):
    table = {"m2": "m²", "M2": "m²", "m²": "m²", "m^2": "m²", "m 2": "m²", "mét vuông": "m²", "met khoi": "m³", "Cái": "cái", "chiếc": "cái", "BỘ": "bộ", "thiết bị": "thiết bị", "Tấn": "tấn", "100m": "100m"}
    assert each(spark, list(table), text.normalize_unit) == list(table.values())


def test_codes_and_ordinals(spark):
    assert each(spark, ["M01", "M.01", "M/01", " AB_12 ", "=A1", ""], text.normalize_code) == ["M-01", "M-01", "M-01", "AB-12", "", ""]
    assert each(spark, [" I.1 ", "1.2.3", " A-01 ", "=ROW()-1", ""], text.normalize_ordinal) == ["I.1", "1.2.3", "A-01", "", ""]


@pytest.mark.parametrize("a,b", [("Tủ điện LV-G.1 + LV-G.2", "TU DIEN LV G 1 LV G 2"), ("Cáp điện 3×2.5 mm²", "cap dien 3x2 5 mm2")])
def test_names(spark, a, b):
    x, y = each(spark, [a, b], text.normalize_name)
    assert x == y


def test_natural_order(spark):
    rows = spark.createDataFrame([(x,) for x in ["1.10", "1.2", "A", "", "2"]], "v string")
    assert [r["v"] for r in rows.orderBy(text.ordinal_key(F.col("v"))).collect()] == ["1.2", "1.10", "2", "A", ""]


def test_ratios():
    assert similarity.ratio("", "") == 100 and similarity.ratio("abcd", "abed") == 75
    assert similarity.token_set_ratio("a b", "b a c") == 100 and similarity.token_set_ratio("", "a") == 0
    assert similarity.partial_ratio("abc", "xxabcxx") == 100 and similarity.weighted_ratio("", "a") == 0
