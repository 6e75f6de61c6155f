"""The rules on matched rows, by thresholds and by hand."""

import pytest

from tallyloom.operators import rules

ITEM = "struct<sheet:string,row_type:string,item_name:string,item_code:string,unit:string,material:string,brand:string,origin:string,quantity:double,reference_quantity:double,bid_quantity:double,unit_price_total:double,amount:double,price_main:double,price_labor:double,price_aux:double,price_management:double,price_profit:double,data_quality_flags:array<string>>"
FIELDS = [f.split(":")[0] for f in ITEM[7:-1].split(",")]
BASE = {"sheet": "BOQ", "row_type": "detail", "item_name": "Tủ điện tổng", "item_code": "M-01", "unit": "m2", "quantity": 100.0, "reference_quantity": 100.0, "unit_price_total": 1e6, "amount": 1e8}


def judged(spark, rows, catalogue=False):
    side = lambda x: None if x is None else tuple((BASE | x).get(f) for f in FIELDS)
    data = [(k, side(r), side(c), kind, score, lexical) for k, (r, c, kind, score, lexical) in enumerate(rows)]
    df = spark.createDataFrame(data, f"k int, r {ITEM}, c {ITEM}, kind string, score double, lexical_score double")
    out = rules.compare_rows(df, catalogue).orderBy("k").collect()
    return [({(f.field, f.severity, round(f.points, 6)) for f in r.findings}, r.severity, round(r.anomaly_score, 6), len(r.notes)) for r in out]


def test_full(spark):
    pair = lambda c, r=None, kind="exact_code", score=1.0, lexical=1.0: (r or {}, c, kind, score, lexical)
    flags = {"data_quality_flags": ["#REF! in price", "blank unit"]}
    rows = [
        pair({}), pair(None), (None, {}, "extra", 0.0, 0.0), pair({"sheet": "Other"}), pair({"unit": "mét vuông"}),
        pair({"unit_price_total": 1.2e6}), pair({"unit_price_total": 1.3e6}), pair({"unit_price_total": 3e6}), pair({"unit_price_total": 3e6, "row_type": "component"}),
        pair({"quantity": None}), pair({}, kind="fuzzy", score=0.6), pair({}, lexical=0.7), pair({}, lexical=0.5), pair({"brand": "ABB"}), pair(flags),
        pair({"price_main": 5e6}, {"price_main": 1e6}), pair({"amount": 2e6}, {"amount": 0.0}), pair({"amount": 2e5}, {"amount": 0.0}),
        pair({"quantity": 200.0, "unit_price_total": 9e6, "amount": 9e9}, lexical=0.1),
    ]
    got = judged(spark, rows)
    one = lambda f, s, p, n=0: ({(f, s, p)}, s, p, n)
    ok = (set(), "OK", 0.0, 0)
    assert got[:5] == [ok, one("missing", "CRITICAL", 45.0), one("extra", "WARNING", 30.0), (set(), "OK", 0.0, 1), ok]
    price = "unit_price_total"
    assert got[5:9] == [one(price, "WARNING", 20.0), one(price, "WARNING", 20.0), one(price, "CRITICAL", 35.0), one(price, "WARNING", 20.0)]
    assert got[9:14] == [one("quantity", "REVIEW", 15.0), one("item_name", "REVIEW", 18.0), one("item_name", "WARNING", 20.0), one("item_name", "CRITICAL", 32.0), one("brand", "REVIEW", 4.0)]
    assert got[14] == ({("data_quality", "CRITICAL", 22.0), ("data_quality", "REVIEW", 5.0)}, "CRITICAL", 27.0, 0)
    assert got[15:18] == [one("price_main", "WARNING", 7.0), one("amount", "CRITICAL", 32.0), one("amount", "WARNING", 18.0)]
    assert got[18][1:3] == ("CRITICAL", 100.0)


@pytest.mark.parametrize("bid, want", [(104.9, "OK"), (105.1, "WARNING"), (115.1, "CRITICAL"), (None, "REVIEW")])
def test_catalogue(spark, bid, want):
    assert judged(spark, [({}, {"bid_quantity": bid, "unit_price_total": 9e9}, "exact_code", 1.0, 1.0)], True)[0][1] == want


def test_no_rows(spark):
    df = spark.createDataFrame([], f"r {ITEM}, c {ITEM}, kind string, score double, lexical_score double")
    assert rules.compare_rows(df).count() == 0
