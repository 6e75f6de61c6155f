"""Sheets of bills of quantities as typed item rows: header, columns, row types, section path, flags."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import math_error, parse_number, safe_amount
from ..functions.text import normalize_code, normalize_name, normalize_ordinal, normalize_unit

# Sheets that hold no items, terms of a header row, and marks of a broken formula.
SKIP_SHEETS = ("tong hop", "dieu khoan", "bia", "muc luc", "chart", "dashboard")
HEADER_TERMS = (
    "stt", "dien giai", "diễn giải", "noi dung cong viec", "nội dung công việc", "don vi", "đơn vị", "khoi luong", "khối lượng", "kl moi thau", "kl nhà thầu",
    "don gia", "đơn giá", "thanh tien", "thành tiền", "thuong hieu", "thương hiệu", "xuat xu", "xuất xứ", "ma hieu", "mã hiệu", "mo ta", "mô tả",
    "ten hang muc", "tên hạng mục", "dvt", "đvt", "so luong", "số lượng", "hang muc", "hạng mục", "dv tinh", "đv tính", "noi dung", "nội dung", "so thu tu", "số thứ tự",
)
HEADER_BONUS = ((r"stt|\btt\b", 8), (r"dien giai|noi dung cong viec|danh muc|hang muc|hạng mục", 8), (r"don gia|thanh tien", 6))
HEADER_LEAST, HEADER_ROWS, HEADER_DEPTH = 16, 60, 3
FORMULA_ERROR = r"(?i)#(?:REF!|DIV/0!|VALUE!|NAME\?|N/A|NUM!|NULL!)"
BLANK_RUN = 250
#: Row numbers of a sheet that one task takes together.
STRETCH = 32_768


class Rule(NamedTuple):
    """A header that has ``has`` and ``also`` and lacks ``lacks`` names ``field`` with that many points; OFFER_ stands for bid_ or reference_ by role."""

    field: str
    points: int
    has: str
    also: str = ""
    lacks: str = "$^"


_GROUP = "thong tin ve vat lieu chinh"
_PART = "vl chinh|vl phu|nc m|quan ly|loi nhuan"
_FIGURE = "thanh tien|don gia|gia tri|khoi luong|so luong|quy cach"
# The first rule that fits a column names it; a field takes its best column, the left one at a tie.
COLUMN_RULES = (
    Rule("stt", 100, r"\bstt\b"), Rule("item_name", 100, "dien giai|noi dung cong viec|danh muc quat thong gio|ten hang muc"), Rule("unit", 95, r"don vi|\bdvt\b", lacks="don gia"),
    Rule("bid_quantity", 110, "kl nha thau|khoi luong nha thau"),
    Rule("reference_quantity", 110, "kl moi thau|khoi luong moi thau", "lan 2"), Rule("reference_quantity", 90, "kl moi thau|khoi luong moi thau", "bim"), Rule("reference_quantity", 80, "kl moi thau|khoi luong moi thau"),
    Rule("material", 110, "mo ta quy cach|quy cach$", _GROUP), Rule("item_code", 110, "ma hieu", _GROUP), Rule("brand", 110, "thuong hieu", _GROUP), Rule("origin", 110, "xuat xu", _GROUP),
    Rule("price_main", 110, "vl chinh", "don gia"), Rule("price_aux", 110, "vl phu", "don gia"), Rule("price_labor", 110, "nc m|nhan cong", "don gia"),
    Rule("price_management", 110, "cf quan ly|chi phi quan ly"), Rule("price_profit", 110, "loi nhuan"), Rule("unit_price_total", 120, "dg tong hop|don gia tong hop"),
    Rule("bid_amount", 120, "thanh tien", "nha thau|hsdt"), Rule("reference_amount", 115, "thanh tien", "klmt|moi thau"), Rule("reference_amount", 70, "thanh tien", "boq"),
    Rule("note", 70, "ghi chu"), Rule("item_code", 70, "ma hieu|ma cong tac"), Rule("unit_price_total", 70, "don gia", lacks=_PART), Rule("OFFER_amount", 60, "thanh tien"),
    Rule("OFFER_quantity", 50, r"khoi luong|\bkl\b"), Rule("material", 50, "quy cach|vat tu|vat lieu"), Rule("brand", 60, "thuong hieu|nhan hieu"), Rule("origin", 60, "xuat xu"),
    Rule("stt", 90, "^(tt|so tt)$|so thu tu"), Rule("unit", 80, "dv tinh|^dv$"), Rule("OFFER_quantity", 45, r"so luong|\bsl\b"),
    Rule("item_name", 60, "hang muc|noi dung|mo ta|ten cong viec", lacks=_FIGURE), Rule("unit_price_total", 55, "^(gia|gia chao|don gia chao)$"),
)
TECHNICAL = r"\btang\s*(?:\d+|ham|h\b)|cong suat|luu luong|cot ap|dien ap|nguon dien|moi chat|do on|hieu suat|toc do|nhiet do|ky hieu|quy cach"
NOT_TECHNICAL = ("cong ty", "lien danh", "khoi luong moi thau", _GROUP, "don gia chua bao gom vat", "thanh tien boq")
TEXT_FIELDS = ("stt", "item_code", "item_name", "unit", "material", "brand", "origin", "note")
PRICE_PARTS = ("price_main", "price_aux", "price_labor", "price_management", "price_profit")
NUMBER_FIELDS = ("reference_quantity", "bid_quantity", *PRICE_PARTS, "unit_price_total", "reference_amount", "bid_amount")
TOTALS = ("tong cong", "tong truoc thue", "thue vat", "tong sau thue")


def folded(text: str, accents: bool = True) -> str:
    """The words of a header in lower case, without accents on demand."""
    out = unicodedata.normalize("NFKC", text or "").strip().lower().replace("×", "x").replace("ø", " phi ").replace("^2", "2").replace("^3", "3")
    if not accents:
        out = "".join(c for c in unicodedata.normalize("NFD", out.replace("đ", "d")) if unicodedata.category(c) != "Mn")
        return " ".join(re.findall(r"[0-9a-z]+", out))
    return " ".join(re.findall(r"[0-9a-zA-ZÀ-ỹ]+", out))


def flat_header(grid: list[dict[int, str]], width: int) -> list[str]:
    """One label a column from rows of a band: a blank cell takes what stands left of it in its row, else what its column had above; equal parts count once."""
    above, parts = [""] * width, [{} for _ in range(width)]
    for row in grid:
        left = ""
        for c in range(width):
            left = row.get(c, "") or left
            above[c] = left or above[c]
            if key := folded(above[c]):
                parts[c].setdefault(key, above[c])
    return [" | ".join(p.values()) for p in parts]


def header_score(labels: list[str]) -> int:
    """Three points a known term, bonuses, and a point a filled column up to 20."""
    keys = [folded(x) for x in labels]
    line = " | ".join(keys)
    return sum(3 for t in HEADER_TERMS if t in line) + sum(p for pattern, p in HEADER_BONUS if re.search(pattern, line)) + min(20, sum(map(bool, keys)))


def find_header(rows: dict[int, dict[int, str]]) -> tuple[int, int, list[str]] | None:
    """(first row, last row, labels) of the best band of one to three of the first rows, the shallower and then the earlier at a tie; None below HEADER_LEAST.

    ``rows`` has the filled cells by row (from 1) and column (from 0).
    """
    width = 1 + max((c for r in rows.values() for c in r), default=-1)
    bands = [(start, depth) for start in range(1, HEADER_ROWS + 1) if len(rows.get(start, ())) >= 2 for depth in range(1, HEADER_DEPTH + 1) if start + depth - 1 <= min(HEADER_ROWS, max(rows))]
    scored = [(header_score(labels), -depth, -start, labels) for start, depth in bands for labels in [flat_header([rows.get(k, {}) for k in range(start, start + depth)], width)]]
    if not scored or (best := max(scored, key=lambda x: x[:3]))[0] < HEADER_LEAST:
        return None
    return -best[2], -best[2] - best[1] - 1, best[3]


def name_columns(labels: list[str], bid: bool) -> dict[int, tuple[str, str]]:
    """{column: (field, label)}; technical columns have the field ``technical``."""
    best: dict[str, tuple[int, int]] = {}
    keys = [folded(x, accents=False) for x in labels]
    for c, key in enumerate(keys):
        rule = next((r for r in COLUMN_RULES if key and re.search(r.has, key) and re.search(r.also, key) and not re.search(r.lacks, key)), None)
        if rule:
            field = rule.field.replace("OFFER_", "bid_" if bid else "reference_")
            points = rule.points - 10 * (field == "note" and c >= 10)
            best[field] = max(best.get(field, (0, 1)), (points, -c))
    out = {-c: (field, labels[-c]) for field, (_, c) in best.items()}
    for c, key in enumerate(keys):
        if c not in out and key and re.search(TECHNICAL, key) and not any(key.endswith(x) for x in NOT_TECHNICAL):
            out[c] = ("technical", labels[c].split("|")[-1].strip() or labels[c].strip())
    return out


def sheet_columns(cells: DataFrame, bid: bool = True) -> DataFrame:
    """(workbook, sheet, header_start, header_end, column_number, field, label) of every sheet with a header and a column of names.

    Only the first HEADER_ROWS rows of a sheet go to one task. Sheets of the
    skip list have none. ``cells`` as ``read_workbooks`` gives them.
    """
    top = cells.where((F.col("row_number") <= HEADER_ROWS) & (F.trim("text") != "") & ~normalize_name(F.col("sheet")).isin(*SKIP_SHEETS))

    def judge(frame):
        import pandas as pd

        rows: dict[int, dict[int, str]] = {}
        for r, c, text in zip(frame["row_number"], frame["column_number"], frame["text"]):
            rows.setdefault(int(r), {})[int(c) - 1] = text.strip()
        found = find_header(rows)
        named = name_columns(found[2], bid) if found else {}
        if "item_name" not in {f for f, _ in named.values()}:
            named = {}
        first = frame.iloc[0]
        data = [(first["workbook"], first["sheet"], found[0], found[1], c + 1, f, label) for c, (f, label) in sorted(named.items())]
        return pd.DataFrame(data, columns=["workbook", "sheet", "header_start", "header_end", "column_number", "field", "label"])

    schema = "workbook string, sheet string, header_start int, header_end int, column_number int, field string, label string"
    return top.select("workbook", "sheet", "row_number", "column_number", "text").groupBy("workbook", "sheet").applyInPandas(judge, schema)


def numbering_row(values: Column) -> Column:
    """Whether a row only numbers its columns: 1, 2, 3, 4 first, and 70 % of its filled cells are numbers or number = formula."""
    plain = F.transform(values, lambda v: F.regexp_replace(v, r"\.0+$", ""))
    start = F.transform(F.slice(plain, 1, 4), lambda v: F.regexp_extract(v, r"^(\d+)", 1).try_cast("int"))
    labels = F.size(F.filter(plain, lambda v: v.rlike(r"^\d+(\s*=.*)?$")))
    return (F.size(values) >= 4) & start.eqNullSafe(F.array(*map(F.lit, (1, 2, 3, 4)))) & (labels >= 0.7 * F.size(values))


def section_level(ordinal: Column, name: Column) -> Column:
    """Level of a heading by its normalised ordinal: a letter 0, a roman number 1, numbers 2 and more by their dots (5 at most), without one 3, or 4 for long names."""
    dots = F.length(ordinal) - F.length(F.replace(ordinal, F.lit("."), F.lit("")))
    return F.when(ordinal.rlike(r"(?i)^[A-Z]([.\-]|$)"), 0).when(ordinal.rlike(r"(?i)^[IVXLCDM]+([.\-]|$)"), 1).when(ordinal.rlike(r"^\d+(\.\d+)*([.\-]|$)"), F.least(2 + dots, F.lit(5))).otherwise(F.when(F.length(name) < 160, 3).otherwise(4))


def typed(rows: DataFrame) -> DataFrame:
    """Adds row_type and level to rows of the text and number fields, raw_reference_amount and raw_bid_amount: summary, group, detail or component."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    ordinal = normalize_ordinal(F.col("stt"))
    money = F.col("raw_reference_amount").isNotNull() | F.col("raw_bid_amount").isNotNull()
    figures = F.col("reference_quantity").isNotNull() | F.col("bid_quantity").isNotNull() | F.col("unit_price_total").isNotNull()
    total = blank("unit") & blank("stt") & normalize_name(F.col("item_name")).rlike("|".join(TOTALS)) & money
    subtotal = ~blank("item_name") & blank("unit") & ~figures & money & ordinal.rlike(r"(?i)^([A-Z]|[IVXLCDM]+)([.\-]|$)")
    group = ~blank("item_name") & blank("unit") & ~figures & ~money & (F.length(F.trim("item_name")) < 220)
    kind = F.when(total | subtotal, "summary").when(group, "group").when(ordinal != "", "detail").otherwise("component")
    out = rows.withColumns({"normalized_stt": ordinal, "row_type": kind})
    return out.withColumn("level", F.when(F.col("row_type") == "group", section_level(F.col("normalized_stt"), F.col("item_name"))))


def with_sections(rows: DataFrame, *sheet: str) -> DataFrame:
    """Adds section_path and section_codes: the open headings above a row, and for a component the detail it belongs to.

    A heading closes all deeper ones; headings and totals end the detail that
    components belong to. Sheets are taken in stretches of STRETCH row numbers;
    what stands open before a stretch comes from a summary of those before it.
    """
    row, level, kind = F.col("row_number"), F.col("level"), F.col("row_type")
    code = F.coalesce(F.nullif(F.col("normalized_stt"), F.lit("")), normalize_code(F.col("item_code")))
    detail = kind == "detail"
    seen = {f"r{k}__": F.when(level == k, row) for k in range(6)} | {f"a{k}__": F.when(level < k, row) for k in range(1, 6)}
    seen |= {f"n{k}__": F.when(level == k, F.col("item_name")) for k in range(6)} | {f"c{k}__": F.when(level == k, F.col("normalized_stt")) for k in range(6)}
    seen |= {"rd__": F.when(detail, row), "rg__": F.when(kind.isin("group", "summary"), row), "nd__": F.when(detail, F.col("item_name")), "cd__": F.when(detail, code)}
    own = [*sheet, "stretch__"]
    cut = rows.withColumn("stretch__", F.floor(row / STRETCH))
    ends = cut.groupBy(*own).agg(*[F.max(F.when(v.isNotNull(), F.struct(row.alias("row"), v.alias("v")))).alias(c) for c, v in seen.items()])
    earlier = Window.partitionBy(*sheet).orderBy("stretch__").rowsBetween(Window.unboundedPreceding, -1)
    open_before = ends.select(*[F.col(c).alias(f"{c}k") for c in own], *[F.last(F.col(c), ignorenulls=True).over(earlier)["v"].alias(f"{c}b") for c in seen])
    same = F.lit(True)
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}k"))
    held = cut.join(open_before, same, "left")
    before = Window.partitionBy(*own).orderBy("row_number").rowsBetween(Window.unboundedPreceding, 0)
    last = {c: F.coalesce(F.last(v, ignorenulls=True).over(before), F.col(f"{c}b")) for c, v in seen.items()}
    last["a0__"] = F.lit(None)
    open_ = []
    for k in range(6):
        alive = last[f"r{k}__"] > F.coalesce(last[f"a{k}__"], F.lit(-1))
        open_.append(F.when(alive, F.struct(last[f"n{k}__"].alias("name"), last[f"c{k}__"].alias("code"))))
    within = last["rd__"] > F.coalesce(last["rg__"], F.lit(-1))
    parent = F.when(within & (kind == "component"), F.struct(last["nd__"].alias("name"), last["cd__"].alias("code")))
    out = held.withColumn("path__", F.array_compact(F.array(*open_, parent)))
    part = lambda f: F.filter(F.transform("path__", lambda p: p[f]), lambda x: x != "")
    return out.withColumns({"section_path": part("name"), "section_codes": part("code")}).drop("path__", "stretch__", *[f"{c}k" for c in own], *[f"{c}b" for c in seen])


def quality_flags(bid: Column, has_price: Column, has_amount: Column) -> Column:
    """What a typed row lacks or gets wrong: quantity, price, amount, product, and the sum of its price parts."""
    quantity = F.when(bid, F.col("bid_quantity")).otherwise(F.col("reference_quantity"))
    amount = F.when(bid, F.col("bid_amount")).otherwise(F.col("reference_amount"))
    price, kind = F.col("unit_price_total"), F.col("row_type")
    parts = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in PRICE_PARTS[1:]), F.coalesce(F.col(PRICE_PARTS[0]), F.lit(0.0)))
    any_part = F.coalesce(*[F.col(p) for p in PRICE_PARTS]).isNotNull()
    off = parts - price
    unsound = any_part & (F.abs(off) / F.greatest(F.abs(price), F.abs(parts), F.lit(1.0)) > 0.005)
    detail, item = kind == "detail", kind.isin("detail", "component")
    wrong = math_error(quantity, price, amount)
    said = (
        F.when(detail & quantity.isNull(), "Thiếu khối lượng"),
        F.when(detail & has_price & price.isNull(), "Thiếu đơn giá tổng hợp"),
        F.when(detail & has_amount & amount.isNull(), "Thiếu thành tiền"),
        F.when((kind == "component") & (F.col("unit") != "") & quantity.isNull(), "Thiếu khối lượng cấu thành"),
        F.when(item & has_price & has_amount & wrong.isNotNull(), F.concat(F.lit("Sai phép tính KL×ĐG, lệch "), F.format_number(wrong, 0))),
        F.when(item & unsound, F.concat(F.lit("Tổng 5 thành phần giá lệch ĐG tổng hợp "), F.when(off >= 0, "+").otherwise(""), F.format_number(off, 0))),
    )
    return F.array_compact(F.array(*said))


def structural_key() -> Column:
    some = lambda c: F.nullif(c, F.lit(""))
    code = F.coalesce(some(F.col("normalized_stt")), some(F.col("normalized_code")))
    return F.concat_ws("::", some(normalize_name(F.col("sheet"))), some(F.col("normalized_path")), code, F.when(F.col("row_type") == "component", some(F.col("normalized_name"))), F.col("row_type"))


def load_items(cells: DataFrame, bid: bool = True, max_rows: int = 1_000_000) -> DataFrame:
    """Item rows of every sheet of ``cells`` (as ``read_workbooks`` gives them), by the column names of each sheet.

    item_id, workbook, sheet, row_number, the text and number fields, technical
    (a map), row_type, section_path, section_codes, the normalised keys,
    structural_key, data_quality_flags, is_comparable, quantity and amount.
    ``bid``: whether the files are offers or the invitation. Rows without name
    and code, and numbering rows, are left out; a sheet ends where more than
    BLANK_RUN rows in a row are blank, or after ``max_rows`` rows, see
    :func:`load_warnings`. Sheets without a header give nothing.
    """
    return _finished(_gathered(cells, bid, max_rows).where(~F.col("over")), bid)


def _gathered(cells: DataFrame, bid: bool, max_rows: int) -> DataFrame:
    columns = sheet_columns(cells, bid)
    heads = columns.groupBy("workbook", "sheet").agg(F.max("header_end").alias("header_end"), F.max((F.col("field") == "unit_price_total").cast("int")).alias("prices"), F.max(F.col("field").isin("reference_amount", "bid_amount").cast("int")).alias("amounts"))
    body = cells.where("kind <> 'unreadable'").join(heads, ["workbook", "sheet"]).where("row_number > header_end")
    body = body.join(columns.select("workbook", "sheet", "column_number", "field", "label"), ["workbook", "sheet", "column_number"], "left")
    # A number is parsed once a cell, not once a field: the expression is large.
    parsed = F.when(F.col("kind") == "number", F.col("number")).when(F.col("field").isin(*NUMBER_FIELDS), parse_number(F.trim(F.coalesce("text", F.lit("")))))
    body = body.select("*", F.inline(F.array(F.struct(parsed.alias("parsed")))))
    text = F.trim(F.coalesce("text", F.lit("")))
    of = lambda f, value: F.max(F.when(F.col("field") == f, value))
    number = lambda f: of(f, F.col("parsed"))
    ordered = F.array_sort(F.collect_list(F.when(text != "", F.struct(F.col("column_number").alias("c"), text.alias("t"), F.col("field").alias("f"), F.col("label").alias("l")))))
    rows = body.groupBy("workbook", "sheet", "row_number", "header_end", "prices", "amounts").agg(*[F.coalesce(of(f, text), F.lit("")).alias(f) for f in TEXT_FIELDS], *[number(f).alias(f) for f in NUMBER_FIELDS], ordered.alias("filled"))
    rows = rows.where(F.size("filled") > 0).withColumn("numbering", numbering_row(F.transform("filled", lambda x: x["t"])))
    sheet = Window.partitionBy("workbook", "sheet").orderBy("row_number")
    legends = F.sum(F.col("numbering").cast("int")).over(sheet.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("legends", legends).where(~F.col("numbering"))
    previous = F.coalesce(F.lag(F.col("row_number") - F.col("legends")).over(sheet), F.col("header_end").cast("long"))
    gap = F.col("row_number") - F.col("legends") - previous - 1
    rows = rows.withColumn("gap", gap).withColumn("ended", F.max((F.col("gap") > BLANK_RUN).cast("int")).over(sheet.rowsBetween(Window.unboundedPreceding, 0))).where("ended = 0")
    return rows.withColumn("over", F.row_number().over(sheet) > max_rows).drop("gap", "ended", "legends", "numbering")


def _finished(rows: DataFrame, bid: bool) -> DataFrame:
    rows = rows.where("item_name <> '' or item_code <> ''")
    total = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in PRICE_PARTS[1:]), F.coalesce(F.col(PRICE_PARTS[0]), F.lit(0.0)))
    price = F.coalesce(F.col("unit_price_total"), F.when(F.coalesce(*map(F.col, PRICE_PARTS)).isNotNull(), total))
    rows = rows.withColumns({"raw_reference_amount": F.col("reference_amount"), "raw_bid_amount": F.col("bid_amount"), "unit_price_total": price})
    rows = rows.withColumns({f"{s}_amount": safe_amount(F.col(f"{s}_quantity"), F.col("unit_price_total"), F.col(f"{s}_amount")) for s in ("reference", "bid")})
    rows = with_sections(typed(rows), "workbook", "sheet")
    technical = F.map_from_entries(F.array_distinct(F.transform(F.filter("filled", lambda x: x["f"] == "technical"), lambda x: F.struct(x["l"].alias("key"), x["t"].alias("value")))))
    broken = F.transform(F.filter("filled", lambda x: x["t"].rlike(FORMULA_ERROR)), lambda x: F.concat(F.lit("Lỗi dữ liệu tại cột "), x["c"].cast("string"), F.lit(": "), x["t"]))
    rows = rows.withColumns({"technical": technical, "normalized_code": normalize_code(F.col("item_code")), "normalized_name": normalize_name(F.col("item_name")), "normalized_unit": normalize_unit(F.col("unit")), "normalized_path": normalize_name(F.array_join("section_path", " | "))})
    flags = F.array_distinct(F.concat(broken, quality_flags(F.lit(bid), F.col("prices") == 1, F.col("amounts") == 1)))
    rows = rows.withColumns({"structural_key": structural_key(), "data_quality_flags": flags, "is_comparable": F.col("row_type").isin("detail", "component")})
    mine, other = ("bid", "reference") if bid else ("reference", "bid")
    rows = rows.withColumns({m: F.coalesce(F.col(f"{mine}_{m}"), F.col(f"{other}_{m}")) for m in ("quantity", "amount")})
    name = F.sha2(F.concat_ws("|", "workbook", "sheet", F.col("row_number").cast("string")), 256)
    return duplicate_codes(rows.withColumn("item_id", name).drop("filled", "header_end", "prices", "amounts", "over", "level", "raw_reference_amount", "raw_bid_amount"))


def duplicate_codes(items: DataFrame) -> DataFrame:
    """Flags the items of a sheet whose code stands under several names, with the rows that have it."""
    sheet = [c for c in ("workbook",) if c in items.columns] + ["sheet_key", "normalized_code"]
    keyed = items.withColumn("sheet_key", normalize_name(F.col("sheet")))
    shared = keyed.where("is_comparable and normalized_code <> ''").groupBy(*sheet).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.nullif("normalized_name", F.lit(""))).alias("names"), F.array_sort(F.collect_list("row_number")).alias("rows"))
    shared = shared.where("n > 1 and names > 1").withColumn("said", F.concat(F.lit("Mã hiệu trùng nhưng mô tả khác nhau ("), "normalized_code", F.lit("), các dòng: "), F.array_join(F.slice("rows", 1, 20).cast("array<string>"), ", "))).select(*sheet, "said")
    out = keyed.join(shared, sheet, "left")
    own = F.when(F.col("is_comparable") & F.col("said").isNotNull(), F.array("said")).otherwise(F.array().cast("array<string>"))
    return out.withColumn("data_quality_flags", F.concat("data_quality_flags", own)).select(*items.columns)


def load_warnings(cells: DataFrame, bid: bool = True, max_rows: int = 1_000_000) -> DataFrame:
    """(workbook, sheet, warning): sheets without a header, cut sheets, and structural keys that repeat."""
    found = sheet_columns(cells, bid).select("workbook", "sheet").distinct()
    sheets = cells.where("sheet is not null").select("workbook", "sheet").distinct().where(~normalize_name(F.col("sheet")).isin(*SKIP_SHEETS))
    none = sheets.join(found, ["workbook", "sheet"], "left_anti").withColumn("warning", F.lit("no header with a column of names"))
    cut = _gathered(cells, bid, max_rows).where("over").select("workbook", "sheet").distinct().withColumn("warning", F.lit(f"more than {max_rows} rows"))
    keys = load_items(cells, bid, max_rows).where("is_comparable").groupBy("workbook", "sheet", "structural_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return none.unionByName(cut).unionByName(keys.select("workbook", "sheet", F.concat(F.lit("key repeats: "), "structural_key").alias("warning")))


def sheet_totals(items: DataFrame) -> DataFrame:
    """(workbook, sheet, total) of the amounts of details."""
    return items.where("row_type = 'detail' and amount is not null").groupBy("workbook", "sheet").agg(F.sum("amount").alias("total"))


def appendix_role(cells: DataFrame) -> DataFrame:
    """(workbook, role): quantities where a sheet has names with quantities or prices, requirements where one only names materials with brands or origins, else unknown."""
    top = cells.where("row_number <= 300")
    fields = sheet_columns(top, bid=False).groupBy("workbook", "sheet").agg(F.collect_set("field").alias("f"))
    boq = fields.where(F.arrays_overlap("f", F.array(*map(F.lit, ("reference_quantity", "bid_quantity", "unit_price_total", "reference_amount", "bid_amount"))))).select("workbook").distinct().withColumn("boq", F.lit(True))
    words = normalize_name(F.col("text"))
    heads = top.where("row_number <= 40").groupBy("workbook", "sheet", "row_number").agg(F.max((words.contains("vat tu") & ~words.contains("thuong hieu")).cast("int")).alias("a"), F.max((words.contains("thuong hieu") | (words.contains("xuat xu") & ~words.contains("vat tu"))).cast("int")).alias("b"))
    needs = heads.where("a = 1 and b = 1").select("workbook").distinct().withColumn("needs", F.lit(True))
    every = cells.select("workbook").distinct().join(boq, "workbook", "left").join(needs, "workbook", "left")
    return every.select("workbook", F.when(F.col("boq"), "quantities").when(F.col("needs"), "requirements").otherwise("unknown").alias("role"))
