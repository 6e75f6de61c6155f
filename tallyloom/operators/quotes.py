"""Offers side by side: the cells of every bidder, their marks, the order of items, and totals by section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ordinal_key
from .rules import RANK

#: The cell of a bidder's block in which a finding on a field is shown, the first that fits; others stand in the note.
CELLS = (
    ("quantity", "quantity"), ("material", "material"), ("item_code", "item_code"), ("brand", "brand"), ("origin", "origin"), ("price_main", "price_main"), ("price_aux", "price_aux"), ("price_labor", "price_labor"),
    ("price_management", "price_management"), ("price_profit", "price_profit"), ("reference_amount", "reference_amount"), ("unit_price", "unit_price"), ("amount", "bid_amount"),
)


def cell_of(field: Column) -> Column:
    out = F.lit("note")
    for part, cell in reversed(CELLS):
        out = F.when(F.contains(field, F.lit(part)), cell).otherwise(out)
    return out


def marks(rows: DataFrame) -> DataFrame:
    """(canonical_id, bidder, sheet, row_number, cell, severity, message) of offered rows: the worst finding of a cell, the first of equals; the note gathers all that have no cell."""
    found = rows.where("c is not null").select("canonical_id", "bidder", F.col("c.sheet").alias("sheet"), F.col("c.row_number").alias("row_number"), F.posexplode("findings").alias("pos", "f"))
    found = found.select("canonical_id", "bidder", "sheet", "row_number", "pos", cell_of(F.col("f.field")).alias("cell"), F.col("f.severity").alias("severity"), F.concat_ws(": ", "f.field", F.concat_ws(" / ", "f.reference", "f.candidate")).alias("message"))
    rank = F.array_position(F.array(*map(F.lit, RANK)), F.col("severity"))
    worst = F.max_by(F.struct("severity", "message"), F.struct(rank.alias("r"), (-F.col("pos")).alias("p")))
    told = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "message"))), lambda x: x["message"])), " | ")
    out = found.groupBy("canonical_id", "bidder", "sheet", "row_number", "cell").agg(worst.alias("w"), told.alias("told"))
    return out.select("canonical_id", "bidder", "sheet", "row_number", "cell", "w.severity", F.when(F.col("cell") == "note", F.substring("told", 1, 1500)).otherwise(F.col("w.message")).alias("message"))


def findings_sheet(rows: DataFrame) -> DataFrame:
    """One line a row that is not OK: its fields, values, the delta of greatest size, and reasons."""
    shown = F.coalesce("c", "r")
    part = lambda f: F.array_join(F.array_distinct(F.filter(F.transform("findings", lambda x: x[f]), lambda v: v.isNotNull())), "; ")
    deltas = F.array_sort(F.transform(F.filter("findings", lambda x: x["delta"].isNotNull()), lambda x: F.struct((-F.abs(x["delta"])).alias("a"), x["delta"].alias("d"))))
    return rows.where("severity <> 'OK'").select("bidder", *[shown[f].alias(f) for f in ("sheet", "row_number", "stt", "item_name")], "severity", "anomaly_score", part("field").alias("fields"), part("reference").alias("reference"), part("candidate").alias("candidate"), F.get(deltas, 0)["d"].alias("largest_delta"))


def display_sheet() -> Column:
    """An offered row is shown on the bidder's sheet, a missing one on that of the reference."""
    return F.coalesce(F.col("c.sheet"), F.col("r.sheet"))


def order_keys(rows: DataFrame) -> DataFrame:
    """(canonical_id, sheet, section, block, within, row_number): where an item stands, the least of all bidders.

    Section A holds what the reference has, by its ordinals, B what bidders
    added, in their order. A component stands below the last detail of its own
    section; of a bidder most of whose rows the reference lacks (half of
    twenty and more) the file's own order stays and all is section A.
    """
    item = F.coalesce("c", "r")
    kept = rows.where(item["is_comparable"]).select("canonical_id", "bidder", display_sheet().alias("sheet"), item["sheet"].alias("own_sheet"), item["row_number"].alias("row_number"), (item["row_type"] == "detail").alias("detail"), F.col("r").isNotNull().alias("matched"), item["stt"].alias("own_stt"), F.col("r.stt").alias("r_stt"), F.col("c").isNotNull().alias("offered"))
    extra = kept.groupBy("bidder").agg(F.count_if("offered").alias("n"), F.count_if(F.col("offered") & ~F.col("matched")).alias("x"))
    far = extra.select("bidder", ((F.col("n") >= 20) & (F.col("x") >= 0.5 * F.col("n"))).alias("far"))
    kept = kept.join(F.broadcast(far), "bidder")
    before = Window.partitionBy("bidder").orderBy("own_sheet", "row_number", "canonical_id").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda where, value: F.last(F.when(where, value), ignorenulls=True).over(before)
    matched, detail = F.col("matched"), F.col("detail")
    a = last(detail & (matched | F.col("far")), F.when(F.col("far"), F.col("own_stt")).otherwise(F.col("r_stt")))
    b = last(detail & ~matched & ~F.col("far"), F.col("row_number"))
    out = kept.withColumns({"section": F.when(matched | F.col("far"), 0).otherwise(1), "a__": F.coalesce(a, F.lit("")), "b__": F.coalesce(b, F.col("row_number"))})
    block = F.when(F.col("section") == 0, ordinal_key(F.col("a__"))).otherwise(F.array(F.struct(F.lit(3).alias("rank"), F.col("b__").cast("long").alias("number"), F.lit("").alias("suffix"))))
    out = out.withColumns({"block": block, "within": F.when(detail, F.lit(0).cast("long")).otherwise(F.col("row_number").cast("long"))})
    least = F.min(F.struct("sheet", "section", "block", "within", "row_number"))
    return out.groupBy("canonical_id").agg(least.alias("k")).select("canonical_id", "k.*")


def quote_table(rows: DataFrame, bidders: list[str]) -> DataFrame:
    """One line an item with the reference's name, unit and quantity, each bidder's price and amount, and their deviation from the median of two bidders and more."""
    first = F.min_by(F.struct(F.coalesce("r.stt", "c.stt").alias("stt"), F.coalesce("r.item_name", "c.item_name").alias("item_name"), F.coalesce("r.unit", "c.unit").alias("unit"), F.col("r.reference_quantity").alias("quantity")), F.struct(F.col("r").isNull().alias("n"), "bidder"))
    base = rows.groupBy("canonical_id").agg(first.alias("f"), F.median("c.unit_price_total").alias("price_median"), F.count("c.unit_price_total").alias("prices"), F.min("c.unit_price_total").alias("price_low"), F.max("c.unit_price_total").alias("price_high"))
    cells = rows.groupBy("canonical_id").pivot("bidder", bidders).agg(F.first("c.unit_price_total", ignorenulls=True).alias("price"), F.first("c.bid_amount", ignorenulls=True).alias("amount"))
    out = base.join(cells, "canonical_id").join(order_keys(rows), "canonical_id")
    off = lambda b: F.when(F.col("prices") >= 2, F.try_divide(F.col(f"{b}_price") - F.col("price_median"), F.nullif(F.abs("price_median"), F.lit(0.0))))
    level = lambda b: F.when(F.abs(off(b)) >= 0.25, "CRITICAL").when(F.abs(off(b)) >= 0.10, "WARNING")
    more = [x for b in bidders for x in (F.col(f"{b}_price"), F.col(f"{b}_amount"), off(b).alias(f"{b}_deviation"), level(b).alias(f"{b}_mark"))]
    return out.select("sheet", "section", "block", "within", "canonical_id", "f.*", "price_low", "price_median", "price_high", *more).orderBy("sheet", "section", "block", "within")


def roll_up(lines: DataFrame) -> DataFrame:
    """(part, sheet, bidder, by_reference, offered) of lines(sheet, section, bidder, reference_amount, bid_amount).

    A: matched work by sheet and, with a null sheet, of all; B: what bidders
    added, of all sheets; C: A and B together.
    """
    sums = (F.coalesce(F.sum("reference_amount"), F.lit(0.0)).alias("by_reference"), F.coalesce(F.sum("bid_amount"), F.lit(0.0)).alias("offered"))
    a = lines.where("section = 0").rollup("bidder", "sheet").agg(*sums).where("bidder is not null").select(F.lit("A").alias("part"), "sheet", "bidder", "by_reference", "offered")
    b = lines.where("section = 1").groupBy("bidder").agg(*sums).select(F.lit("B").alias("part"), F.lit(None).cast("string").alias("sheet"), "bidder", "by_reference", "offered")
    c = lines.groupBy("bidder").agg(*sums).select(F.lit("C").alias("part"), F.lit(None).cast("string").alias("sheet"), "bidder", "by_reference", "offered")
    return a.unionByName(b).unionByName(c)


def roll_up_rows(rows: DataFrame) -> DataFrame:
    """:func:`roll_up` of compared rows, with the sections of :func:`order_keys`."""
    keys = order_keys(rows).select("canonical_id", "sheet", "section")
    lines = rows.where("c is not null").select("canonical_id", "bidder", F.col("c.reference_amount").alias("reference_amount"), F.col("c.bid_amount").alias("bid_amount")).join(keys, "canonical_id")
    return roll_up(lines)
