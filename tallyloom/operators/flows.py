"""Whole comparisons: reference against bidders, bidders against each other, two versions of an offer, and what is shown of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.numbers import percent_delta
from ..functions.text import canonical_id, normalize_name
from . import rules
from .clusters import constrained_clusters
from .compare import changed
from .matcher import match_items
from .requirements import apply_requirements

#: What is followed from one version of an offer to the next, and how it is compared.
TRACKED = (
    ("item_name", "name"), ("unit", "text"), ("item_code", "text"), ("reference_quantity", "number"), ("bid_quantity", "number"), ("material", "name"), ("brand", "text"), ("origin", "text"),
    ("price_main", "number"), ("price_aux", "number"), ("price_labor", "number"), ("price_management", "number"), ("price_profit", "number"), ("unit_price_total", "number"), ("bid_amount", "number"),
)
UNCHANGED, CHANGED, ADDED, REMOVED = "GIỮ NGUYÊN", "THAY ĐỔI", "THÊM MỚI", "ĐÃ XOÁ"
EXACT = ("exact_structure", "exact_code", "exact_name")


def require_items(items: DataFrame, label: str) -> DataFrame:
    """``items``, or an error that names the file where none can be compared."""
    if items.where("is_comparable").isEmpty():
        raise ValueError(f"no item could be read from {label}: it may hold no bill of quantities")
    return items


def paired(reference: DataFrame, offers: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(bidder, canonical_id, r, c, kind, score, lexical_score, reason) of every bidder of ``offers`` against one reference.

    Items carry a column bidder. The reference meets each bidder by the name
    of the pair, in one run. canonical_id is made of the reference, or of the
    offer where that stands alone.
    """
    bidders = offers.select("bidder").distinct()
    left = reference.drop("bidder").crossJoin(F.broadcast(bidders)).withColumns({"pair": F.col("bidder"), "own_id": F.col("item_id"), "item_id": F.concat_ws("#", "item_id", "bidder")})
    right = offers.withColumn("pair", F.col("bidder"))
    matches = match_items(left, right, settings)
    shared = [c for c in offers.columns if c in reference.columns and c not in ("pair", "bidder")]  # both structs of one type
    r = left.select(F.col("item_id").alias("r_id"), F.struct(*shared).alias("r"))
    c = right.select(F.col("item_id").alias("c_id"), F.struct(*shared).alias("c"))
    both = matches.join(r, "r_id", "left").join(c, "c_id", "left")
    either = lambda f: F.coalesce(F.col(f"r.{f}"), F.col(f"c.{f}"))
    ordinal = F.coalesce(F.col("r.row_number"), F.col("c.row_number") + 1_000_000)
    name = canonical_id(either("sheet"), either("item_code"), either("item_name"), ordinal, F.array_join(either("section_path"), " | "))
    return both.select(F.col("pair").alias("bidder"), name.alias("canonical_id"), "r", "c", "kind", "score", F.col("lexical").alias("lexical_score"), "reason")


def compare_tender(reference: DataFrame, offers: DataFrame, catalogue: bool = False, settings: Settings = Settings()) -> DataFrame:
    """Matched rows of every bidder with findings, notes, severity and anomaly_score, see ``rules.compare_rows``.

    ``catalogue``: the reference lists quantities without prices. Technical
    maps are compared key by key where prices are.
    """
    rows = paired(require_items(reference, "the reference"), require_items(offers, "the offers"), settings)
    return rules.compare_rows(rows, catalogue, technical=not catalogue)


def compare_package(reference: DataFrame, offers: DataFrame, requirements: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``compare_tender`` by an official catalogue, with the requirement, its status and its findings of every offered row."""
    rows = compare_tender(reference, offers, True, settings)
    shown = F.coalesce("r", "c")
    offered = rows.where("c is not null").select("canonical_id", "bidder", F.col("c.item_id").alias("c_id"), *[F.col(f"c.{f}").alias(f) for f in ("sheet", "row_number", "row_type", "brand", "origin", "note", "technical")], *[shown[f].alias(f) for f in ("item_name", "material", "item_code", "normalized_path")])
    judged = apply_requirements(offered, requirements, "canonical_id", settings.requirement_score).select("c_id", "requirement", "requirement_text", "match_score", "status", "issues")
    out = rows.withColumn("c_id", F.col("c.item_id")).join(judged, "c_id", "left").drop("c_id")
    more = F.transform(F.coalesce("issues", F.array().cast("array<struct<field:string,message:string,severity:string,points:double>>")), lambda i: rules.finding(F.concat(F.lit("requirement "), i["field"]), i["severity"], i["points"], F.col("requirement_text"), F.when(i["field"] == "brand", F.col("c.brand")).otherwise(F.col("c.origin"))))
    return rules.with_verdict(out.withColumn("findings", F.concat("findings", more)))


def summary(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """(bidder, rows, matched, missing, extra, critical, warning, review, reference_items, match_ratio, low_match, extra_ratio, scope_mismatch, total) a bidder.

    total adds the amounts of offered details once a sheet and row. low_match:
    under a fifth of ten reference items and more; scope_mismatch: half of
    twenty offered rows and more stand beside the reference.
    """
    n = lambda c: F.count_if(c)
    kind, level = F.col("kind"), F.col("severity")
    alone = kind.isin("missing", "extra")
    counts = rows.groupBy("bidder").agg(F.count(F.lit(1)).alias("rows"), n(~alone).alias("matched"), n(kind == "missing").alias("missing"), n(kind == "extra").alias("extra"), n(level == "CRITICAL").alias("critical"), n(level == "WARNING").alias("warning"), n(level == "REVIEW").alias("review"), n(F.col("c").isNotNull()).alias("offered"))
    once = rows.where("c.row_type = 'detail' and c.amount is not null").groupBy("bidder", F.col("c.sheet").alias("s"), F.col("c.row_number").alias("n")).agg(F.max("c.amount").alias("amount"))
    totals = once.groupBy("bidder").agg(F.sum("amount").alias("total"))
    size = reference.where("is_comparable").agg(F.count(F.lit(1)).alias("reference_items"))
    out = counts.join(totals, "bidder", "left").crossJoin(F.broadcast(size))
    out = out.withColumns({"match_ratio": F.coalesce(F.try_divide("matched", "reference_items"), F.lit(0.0)), "extra_ratio": F.coalesce(F.try_divide("extra", "offered"), F.lit(0.0)), "total": F.coalesce("total", F.lit(0.0))})
    return out.withColumns({"low_match": (F.col("reference_items") >= 10) & (F.col("match_ratio") < 0.2), "scope_mismatch": (F.col("offered") >= 20) & (F.col("extra_ratio") >= 0.5)})


def price_fill_ratio(items: DataFrame, by: str = "bidder") -> DataFrame:
    """(by, fill_ratio, looks_like): the share of details with a price or amount; from a half an offer, up to a twentieth an invitation."""
    priced = (F.col("unit_price_total").isNotNull() | F.col("bid_amount").isNotNull()).cast("double")
    out = items.groupBy(by).agg(F.coalesce(F.avg(F.when(F.col("row_type") == "detail", priced)), F.lit(0.0)).alias("fill_ratio"))
    return out.withColumn("looks_like", F.when(F.col("fill_ratio") >= 0.5, "offer").when(F.col("fill_ratio") <= 0.05, "invitation"))


def flat_rows(rows: DataFrame) -> DataFrame:
    """One flat line a compared row, texts guarded against being run as formulas by a spreadsheet."""
    from ..functions.text import guard_formula

    either = lambda f: F.coalesce(F.col(f"r.{f}"), F.col(f"c.{f}"))
    texts = ("sheet", "stt", "item_code", "item_name", "unit", "row_type")
    numbers = ("reference_quantity", "bid_quantity", "unit_price_total", "amount")
    sides = [x for f in numbers for x in (F.col(f"r.{f}").alias(f"reference_{f.removeprefix('reference_')}"), F.col(f"c.{f}").alias(f"offered_{f}"), percent_delta(F.col(f"r.{f}"), F.col(f"c.{f}")).alias(f"{f}_delta_pct"))]
    said = F.array_join(F.array_distinct(F.transform("findings", lambda f: f["field"])), "; ")
    return rows.select("canonical_id", "bidder", *[guard_formula(either(f)).alias(f) for f in texts], either("row_number").alias("row_number"), "kind", "score", "severity", "anomaly_score", said.alias("fields"), F.size("findings").alias("n_findings"), *sides)


def difference_rows(rows: DataFrame) -> DataFrame:
    """One line a finding."""
    return rows.select("canonical_id", "bidder", F.coalesce("r.item_name", "c.item_name").alias("item_name"), F.inline("findings"))


def anomalies(rows: DataFrame) -> DataFrame:
    return rows.where("severity <> 'OK'")


def unmatched(rows: DataFrame) -> DataFrame:
    """Missing and extra rows with where they stand."""
    shown = F.coalesce("r", "c")
    return rows.where("kind in ('missing', 'extra')").select("canonical_id", "bidder", "kind", *[shown[f].alias(f) for f in ("sheet", "row_number", "item_code", "item_name", "unit")])


def quality_rows(items: DataFrame) -> DataFrame:
    """(workbook, sheet, row_number, flag), each once."""
    return items.select("workbook", "sheet", "row_number", F.explode("data_quality_flags").alias("flag")).distinct()


def preview(rows: DataFrame, most: int = 250, flags: int = 8) -> DataFrame:
    """The worst ``most`` rows that are not OK, with ``flags`` fields each: a top-k report."""
    rank = F.array_position(F.array(*map(F.lit, rules.RANK)), F.col("severity"))
    shown = F.coalesce("r", "c")
    return anomalies(rows).orderBy(rank.desc(), F.desc("anomaly_score"), "canonical_id", "bidder").limit(most).select("canonical_id", "bidder", shown["item_id"].alias("item_id"), shown["unit"].alias("unit"), shown["item_name"].alias("item_name"), "severity", "anomaly_score", F.slice(F.transform("findings", lambda f: f["field"]), 1, flags).alias("flags"))


def needs_price(rows: DataFrame, most: int = 50) -> DataFrame:
    """Rows for the price advisor: without a price, or with a finding on one; if there are none, the first ``most`` with a name."""
    shown = F.coalesce("c", "r")
    asked = F.coalesce(F.col("c.unit_price_total").isNull(), F.lit(True)) | F.exists("findings", lambda f: f["field"].rlike("price|amount|missing"))
    named = rows.where(F.trim(shown["item_name"]) != "").select("canonical_id", "bidder", shown["item_id"].alias("item_id"), shown["item_name"].alias("item_name"), shown["unit"].alias("unit"), asked.alias("asked"))
    chosen = named.where("asked")
    return (named if chosen.isEmpty() else chosen).orderBy("canonical_id", "bidder").limit(most).drop("asked")


def all_pairs(offers: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Matches (a, b, score, kind) of every two bidders, each pair of bidders once; scores under 0.60 stay only where keys are equal."""
    bidders = offers.select("bidder").distinct()
    a, b = bidders.withColumnRenamed("bidder", "one"), bidders.withColumnRenamed("bidder", "two")
    pairs = F.broadcast(a.join(b, F.col("one") < F.col("two")).withColumn("pair", F.concat_ws("#", "one", "two")))
    mark = lambda side: offers.join(pairs, offers.bidder == pairs[side]).withColumn("item_id", F.concat_ws("@", "item_id", "pair")).drop("one", "two")
    found = match_items(mark("one"), mark("two"), settings).where("r_id is not null and c_id is not null")
    least = max(0.60, settings.thresholds.name_reject_score)
    own = lambda c: F.substring_index(c, "@", 1)
    return found.where((F.col("score") >= least) | F.col("kind").isin(*EXACT)).select(own(F.col("r_id")).alias("a"), own(F.col("c_id")).alias("b"), "score", "kind")


def most_common(value: Column, order: Column) -> Column:
    """Of a group the text said most often in any case, the one said first at a tie, in its longest spelling (an aggregate)."""
    said = F.array_sort(F.collect_list(F.when(F.trim(value) != "", F.struct(order.alias("o"), F.trim(value).alias("v")))))
    keys = F.transform(said, lambda x: F.lower(x["v"]))
    counts = F.transform(F.array_distinct(keys), lambda k: F.struct(F.size(F.filter(keys, lambda x: x == k)).alias("n"), (-F.array_position(keys, k)).alias("first"), k.alias("k")))
    best = F.array_max(counts)["k"]
    spelled = F.transform(F.filter(said, lambda x: F.lower(x["v"]) == best), lambda x: F.struct(F.length(x["v"]).alias("n"), (-F.array_position(said, x)).alias("first"), x["v"].alias("v")))
    return F.coalesce(F.array_max(spelled)["v"], F.lit(""))


def peer_catalogue(offers: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(canonical_id, bidder, kind, item_id, sheet, row_number, consensus fields): every cluster of the bidders' items with every bidder.

    Clusters join the matches of all pairs of bidders from the best down, and
    none has a bidder twice. They are numbered by the document order of their
    first member. A bidder without an item of a cluster is ``missing`` there.
    Groups are no larger than there are bidders.
    """
    items = offers.where("is_comparable").withColumn("n__", F.xxhash64("item_id"))
    ids = items.select("item_id", "n__")
    found = all_pairs(items.drop("n__"), settings)
    edges = found.join(ids.select(F.col("item_id").alias("a"), F.col("n__").alias("na")), "a").join(ids.select(F.col("item_id").alias("b"), F.col("n__").alias("nb")), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"), "score")
    clusters = constrained_clusters(items.select(F.col("n__").alias("id"), "bidder"), edges)
    members = items.join(clusters, items.n__ == clusters.id).drop("id", "n__")
    order = F.struct("sheet", "row_number", "bidder")
    said = {f: most_common(F.col(f), order) for f in ("sheet", "stt", "item_code", "item_name", "unit", "material")}
    best = F.struct(F.length("item_name").alias("n"), (F.col("item_code") != "").alias("c"), (-F.col("row_number")).alias("r"), (-F.xxhash64("item_id")).alias("i"))
    heads = members.groupBy("cluster").agg(F.min(order).alias("first"), F.max_by(F.struct("item_name", "row_type", "section_path", "normalized_name"), best).alias("rep"), *[v.alias(f"consensus_{f}") for f, v in said.items()])
    sheets = heads.groupBy(F.col("first.sheet").alias("s__")).agg(F.count(F.lit(1)).alias("n__"))
    offset = F.coalesce(F.sum("n__").over(Window.orderBy("s__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # sheets are few
    heads = heads.withColumn("s__", F.col("first.sheet")).join(F.broadcast(sheets.select("s__", offset.alias("offset__"))), "s__")
    place = F.row_number().over(Window.partitionBy("s__").orderBy("first", "cluster")) + F.col("offset__")
    heads = heads.withColumn("canonical_id", F.format_string("PEER-%07d", place)).drop("first", "s__", "offset__")
    grid = heads.crossJoin(F.broadcast(offers.select("bidder").distinct()))
    held = members.select("cluster", "bidder", "item_id", "sheet", "row_number", "normalized_name")
    out = grid.join(held, ["cluster", "bidder"], "left")
    kind = F.when(F.col("item_id").isNull(), "missing").when(F.col("normalized_name") == normalize_name(F.col("consensus_item_name")), "exact_name").otherwise("fuzzy")
    score = F.when(F.col("kind") == "missing", 0.0).when(F.col("kind") == "exact_name", 1.0).otherwise(0.8)
    return out.withColumn("kind", kind).select("canonical_id", "bidder", "kind", score.alias("score"), "item_id", "sheet", "row_number", "rep.row_type", *[f"consensus_{f}" for f in said])


def version_changes(old: DataFrame, new: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(status, sheet, stt, item_name, unit, row_number, is_new, old_amount, new_amount, changes) of two versions of one offer.

    changes: (field, old_value, new_value, delta, delta_pct) of the TRACKED
    fields that differ: numbers by more than a half or a billionth, texts after
    folding case and space, names after normalising.
    """
    side = lambda df: df.withColumn("pair", F.lit("versions"))
    matches = match_items(side(old), side(new), settings)
    a = old.select(F.col("item_id").alias("r_id"), F.struct(*old.columns).alias("r"))
    b = new.select(F.col("item_id").alias("c_id"), F.struct(*new.columns).alias("c"))
    both = matches.join(a, "r_id", "left").join(b, "c_id", "left")
    fold = lambda c, kind: normalize_name(c) if kind == "name" else F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")
    found = []
    for f, kind in TRACKED:
        x, y = F.col(f"r.{f}"), F.col(f"c.{f}")
        if kind == "number":
            delta = F.coalesce(y, F.lit(0.0)) - F.coalesce(x, F.lit(0.0))
            entry = F.struct(F.lit(f).alias("field"), x.cast("string").alias("old_value"), y.cast("string").alias("new_value"), delta.alias("delta"), F.try_divide(delta, F.nullif(F.abs(x), F.lit(0.0))).alias("delta_pct"))
            found.append(F.when(changed(x, y), entry))
        else:
            none = F.lit(None).cast("double")
            entry = F.struct(F.lit(f).alias("field"), x.alias("old_value"), y.alias("new_value"), none.alias("delta"), none.alias("delta_pct"))
            found.append(F.when(fold(x, kind) != fold(y, kind), entry))
    both = both.withColumn("changes", F.when(F.col("r").isNotNull() & F.col("c").isNotNull(), F.array_compact(F.array(*found))))
    status = F.when(F.col("c").isNull(), REMOVED).when(F.col("r").isNull(), ADDED).when(F.size("changes") > 0, CHANGED).otherwise(UNCHANGED)
    shown = F.coalesce("c", "r")
    return both.select(status.alias("status"), *[shown[f].alias(f) for f in ("sheet", "stt", "item_name", "unit", "row_number")], F.col("c").isNotNull().alias("is_new"), F.col("r.bid_amount").alias("old_amount"), F.col("c.bid_amount").alias("new_amount"), "changes")


def version_totals(rows: DataFrame) -> DataFrame:
    """One row: amounts of both versions, their difference, and the count of each status."""
    n = lambda s: F.count_if(F.col("status") == s)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return rows.agg(total("old_amount").alias("total_old"), total("new_amount").alias("total_new"), (total("new_amount") - total("old_amount")).alias("total_delta"), n(UNCHANGED).alias("unchanged"), n(CHANGED).alias("changed"), n(ADDED).alias("added"), n(REMOVED).alias("removed"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all bidders in one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
