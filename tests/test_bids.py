"""From sheets to compared offers, on small workbooks made here."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import anomaly, flows, items, matcher, quotes, requirements

CELLS = "workbook string, sheet string, row_number long, column_number int, kind string, text string, number double, formula string"
HEAD = ["STT", "Diễn giải", "ĐVT", "Mã hiệu", "Khối lượng", "Đơn giá", "Thành tiền", "Công suất", "Thương hiệu", "Xuất xứ"]
INVITED = [
    ["Bảng khối lượng"], HEAD, [1, 2, 3, 4, 5, 6, 7, 8], ["A", "Phần điện"], ["1", "Tủ phân phối chính", "tủ", "TP-07", 2, 100, 200, "5", "Hoa Sen", "VN"], [None, "Cầu dao 3 cực", "cái", "CD-3", 4, 10, 40],
    ["2", "Cáp ngầm XLPE", "m", None, 100, 5, 501], ["B", "Phần nước"], ["1", "Ống nhựa D25", "m", "ON25", 50, 2, 100], [None, "Tổng cộng", None, None, None, None, 841], *[[]] * 251, ["9", "Sau khoảng trống", "m", None, 1, 1, 1],
]
ALPHA = [
    ["Báo giá"], HEAD, ["A", "Phần điện"], ["1", "Tủ phân phối chính", "tủ", "TP-07", 2, 110, 220, "7", "Hoa Sen", "VN"], [None, "Cầu dao 3 cực", "cái", "CD-3", 4, 10, 40],
    ["2", "Cáp ngầm XLPE", "m", None, 100, 5, 500], ["B", "Phần nước"], ["2", "Van khóa tay gạt", "cái", "VK-11", 3, 7, 21],
]
BETA = [["Báo giá"], HEAD, ["A", "Phần điện"], ["1", "Tủ phân phối chính", "tủ", "TP-07", 2, 300, 600, "5", "Lạ Hoắc", ""], ["B", "Phần nước"], ["1", "Ống nhựa D25", "m", "ON25", 50, 2, 100]]


def cells(spark, **books):
    rows = []
    for name, sheet in books.items():
        for r, row in enumerate(sheet, 1):
            for c, v in enumerate(row, 1):
                if v is not None:
                    number = isinstance(v, (int, float))
                    rows.append((name, "BOQ", r, c, "number" if number else "text", str(v), float(v) if number else None, None))
    return spark.createDataFrame(rows, CELLS)


@pytest.fixture(scope="module")
def invited(spark):
    loaded = items.load_items(cells(spark, invited=INVITED), bid=False)
    return spark.createDataFrame(loaded.collect(), loaded.schema)


@pytest.fixture(scope="module")
def offers(spark):
    loaded = items.load_items(cells(spark, alpha=ALPHA, beta=BETA), bid=True).withColumn("bidder", F.col("workbook"))
    return spark.createDataFrame(loaded.collect(), loaded.schema)


@pytest.fixture(scope="module")
def compared(spark, invited, offers):
    rows = flows.compare_tender(invited, offers)
    return spark.createDataFrame(rows.collect(), rows.schema)


def test_header():
    rows = {1: {0: "Bảng giá"}, 2: {0: "STT", 1: "Nội dung công việc", 2: "Đơn giá", 4: "Ghi chú"}, 3: {2: "Khối lượng", 3: "VL phụ"}, 4: {0: "1", 1: "x"}}
    start, end, labels = items.find_header(rows)
    assert (start, end) == (2, 3) and labels[3] == "Đơn giá | VL phụ"
    assert {c: f for c, (f, _) in items.name_columns(labels, True).items()} == {0: "stt", 1: "item_name", 2: "unit_price_total", 3: "price_aux", 4: "note"}
    assert items.find_header({1: {0: "a", 1: "b"}}) is None and items.find_header({}) is None
    named = items.name_columns(["TT", "Hạng mục", "ĐV", "SL", "Giá", "Tầng 3", "KL mời thầu lần 2", "KL mời thầu"], False)
    assert {c: f for c, (f, _) in named.items()} == {0: "stt", 1: "item_name", 2: "unit", 4: "unit_price_total", 5: "technical", 6: "reference_quantity"}


def test_load_items(spark, invited):
    got = {r["row_number"]: r for r in invited.collect()}
    assert {k: r["row_type"] for k, r in got.items()} == {4: "group", 5: "detail", 6: "component", 7: "detail", 8: "group", 9: "detail", 10: "summary"}
    assert got[6]["section_path"] == ["Phần điện", "Tủ phân phối chính"] and got[9]["section_path"] == ["Phần nước"] and got[5]["technical"] == {"Công suất": "5"}
    assert got[7]["amount"] == 501 and got[7]["data_quality_flags"] == [] and got[5]["normalized_unit"] == "tủ" and got[6]["quantity"] == 4
    said = {r["warning"] for r in items.load_warnings(cells(spark, a=[["x", "y"]], b=INVITED), False, 3).collect()}
    assert said == {"no header with a column of names", "more than 3 rows"}
    assert {r["role"] for r in items.appendix_role(cells(spark, invited=INVITED)).collect()} == {"quantities"}


def test_flags_and_codes(spark):
    sheet = [HEAD, ["1", "Bơm", "cái", "B1", 2, 5, 30], ["2", "Quạt", "cái", "B1", None, 5, "#REF!"]]
    got = {r["row_number"]: r["data_quality_flags"] for r in items.load_items(cells(spark, x=sheet)).collect()}
    assert got[2][0].startswith("Sai phép tính") and "Mã hiệu trùng" in got[2][-1] and "2, 3" in got[2][-1]
    assert got[3][0] == "Lỗi dữ liệu tại cột 7: #REF!" and "Thiếu khối lượng" in got[3] and "Thiếu thành tiền" in got[3]


def test_scores():
    assert matcher.abbreviation("tu dien tong", "tdt") == 1.0 and matcher.abbreviation("tu dien tong hop", "tdh") == 0.9 and matcher.abbreviation("abc", "abc") == 1.0 and matcher.abbreviation("bom", "quat") == 0.0
    assert matcher.lexical("", "a", "", "a") == 0.0 and matcher.lexical("may bom nuoc", "may bom nuoc", "may bom nuoc", "may bom nuoc") == pytest.approx(1.0)


def test_compare(compared, invited):
    got = {(r["bidder"], (r["r"] or r["c"])["item_name"]): r for r in compared.collect()}
    assert {k: r["kind"] for k, r in got.items()} == {
        ("alpha", "Tủ phân phối chính"): "exact_structure", ("alpha", "Cầu dao 3 cực"): "exact_structure", ("alpha", "Cáp ngầm XLPE"): "exact_structure", ("alpha", "Ống nhựa D25"): "missing", ("alpha", "Van khóa tay gạt"): "extra",
        ("beta", "Tủ phân phối chính"): "exact_structure", ("beta", "Cầu dao 3 cực"): "missing", ("beta", "Cáp ngầm XLPE"): "missing", ("beta", "Ống nhựa D25"): "exact_structure",
    }
    fields = {f["field"]: f["severity"] for f in got["alpha", "Tủ phân phối chính"]["findings"]}
    assert fields["technical Công suất"] == "WARNING" and "item_name" not in fields
    assert [f["field"] for f in got["alpha", "Cáp ngầm XLPE"]["findings"]] == ["reference_quantity"]  # an offer's own column of quantities is not the invited one
    total = {r["bidder"]: r for r in flows.summary(compared, invited).collect()}
    assert (total["alpha"]["matched"], total["alpha"]["missing"], total["alpha"]["extra"], total["alpha"]["total"], total["alpha"]["reference_items"]) == (3, 1, 1, 741.0, 4)
    assert flows.unmatched(compared).count() == 4 and flows.preview(compared, 2).count() == 2
    flat = flows.flat_rows(compared)
    assert flat.where("bidder = 'alpha' and item_name = 'Cáp ngầm XLPE'").first()["amount_delta_pct"] == pytest.approx(-1 / 501)
    assert {r["bidder"]: (r["fill_ratio"], r["looks_like"]) for r in flows.price_fill_ratio(compared.where("c is not null").select("bidder", "c.*")).collect()}["alpha"] == (1.0, "offer")


def test_quotes(compared):
    keys = {r["canonical_id"]: (r["sheet"], r["section"]) for r in quotes.order_keys(compared).collect()}
    assert sorted(keys.values()) == [("BOQ", 0)] * 4 + [("BOQ", 1)]
    rolled = {(r["part"], r["sheet"], r["bidder"]): r["offered"] for r in quotes.roll_up_rows(compared).collect()}
    assert rolled == {("A", "BOQ", "alpha"): 760.0, ("A", None, "alpha"): 760.0, ("B", None, "alpha"): 21.0, ("C", None, "alpha"): 781.0, ("A", "BOQ", "beta"): 700.0, ("A", None, "beta"): 700.0, ("C", None, "beta"): 700.0}
    table = {r["item_name"]: r for r in quotes.quote_table(compared, ["alpha", "beta"]).collect()}
    assert table["Tủ phân phối chính"]["beta_mark"] == "CRITICAL" and table["Tủ phân phối chính"]["price_median"] == 205.0 and list(table)[-1] == "Van khóa tay gạt"
    assert "note" in {r["cell"] for r in quotes.marks(compared).collect()} and quotes.findings_sheet(compared).count() == compared.where("severity <> 'OK'").count()


def test_package(spark, invited, offers):
    rows = [["PHỤ LỤC"], ["STT", "Vật tư", "Thương hiệu - Xuất xứ", "Ghi chú"], [None, "Hệ thống điện", None], [1, "Tủ phân phối chính", "Hoa Sen/ Đông Á - Việt Nam; EU"], [2, "Bơm nước", "#N/A"]]
    wanted = requirements.load_requirements(cells(spark, req=rows))
    assert [tuple(r)[3:8] for r in wanted.collect()] == [("Hệ thống điện", "Tủ phân phối chính", "Hoa Sen/ Đông Á - Việt Nam; EU", ["Hoa Sen", "Đông Á"], ["Việt Nam", "EU"])]
    got = flows.compare_package(invited, offers, wanted)
    status = {(r["bidder"], r["c"]["item_name"]): r["status"] for r in got.where("c is not null").collect()}
    assert status["alpha", "Tủ phân phối chính"] == requirements.COMPLIES and status["beta", "Tủ phân phối chính"] == requirements.LACKS and status["alpha", "Van khóa tay gạt"] is None


def test_compliance():
    c = requirements.compliance
    assert c("", "", [], "Chủ đầu tư cấp", ["A"], []) == (requirements.OWNER, [])
    assert c("Rạng Đông", "China", [], "x", ["Rang Dong"], ["Châu Á"])[0] == requirements.COMPLIES
    assert c("Khac Han", "", [], "x", ["Rang Dong"], [])[0] == requirements.REVIEW and c("", "", ["maker rang dong"], "x", ["Rang Dong"], [])[0] == requirements.COMPLIES
    score = requirements.requirement_score
    assert score("", "ong gio") == 0.0 and score("ong pvc luon day", "ong luon day pvc") > score("ong pvc luon day", "thang mang cap") and score("tu dien msb", "tu dien ha the") > 0.9


def test_peers(spark, offers):
    got = flows.peer_catalogue(offers).collect()
    assert len({r["canonical_id"] for r in got}) == 5 and len(got) == 10
    kinds = {(r["consensus_item_name"], r["bidder"]): r["kind"] for r in got}
    assert kinds["Tủ phân phối chính", "alpha"] == kinds["Tủ phân phối chính", "beta"] == "exact_name" and kinds["Ống nhựa D25", "alpha"] == "missing"
    assert {r["canonical_id"] for r in got if r["consensus_item_name"] == "Tủ phân phối chính"} == {"PEER-0000001"}


def test_versions(spark, offers):
    old = offers.where("bidder = 'alpha'")
    new = old.where("row_number <> 5").withColumn("bid_quantity", F.when(F.col("row_number") == 6, 120.0).otherwise(F.col("bid_quantity"))).withColumn("item_id", F.concat("item_id", F.lit("n")))
    rows = flows.version_changes(old, new)
    got = {r["item_name"]: r for r in rows.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"Tủ phân phối chính": flows.UNCHANGED, "Cầu dao 3 cực": flows.REMOVED, "Cáp ngầm XLPE": flows.CHANGED, "Van khóa tay gạt": flows.UNCHANGED}
    assert [(c["field"], c["delta"], c["delta_pct"]) for c in got["Cáp ngầm XLPE"]["changes"]] == [("bid_quantity", 20.0, 0.2)]
    assert flows.version_totals(rows).first()["removed"] == 1


def test_forest(spark):
    rows = [(k, "detail", 0.1, 0.0, 1.0, "m", "m", 100.0 + k % 7) for k in range(80)] + [(99, "detail", 9.0, 8.0, 0.6, "m", "kg", 1e7), (100, "component", 9.0, 8.0, 0.6, "m", "kg", 1e7)]
    df = spark.createDataFrame(rows, "id long, row_type string, price_delta_pct double, quantity_delta_pct double, score double, reference_unit string, candidate_unit string, unit_price_total double")
    got = {r["id"]: r["signal"] for r in anomaly.forest_signal(df, "id").collect()}
    assert len(got) == 81 and got[99] == 1.0 and sum(v >= anomaly.LEAST_SIGNAL for v in got.values()) <= 6 and anomaly.forest_signal(df.limit(5), "id").count() == 0
