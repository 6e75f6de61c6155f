"""Findings on matched rows: each rule gives a struct or null, a row keeps those found, their worst severity and their points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_number, percent_delta
from ..functions.similarity import text_similarity
from ..functions.text import normalize_name, normalize_unit
from .compare import RANK, numeric_difference

FINDING = "struct<field:string,reference:string,candidate:string,delta:double,delta_pct:double,similarity:double,severity:string,points:double>"
#: Name similarity or match score below which a matched name is doubtful, and below which it is another item's.
NAME_REVIEW, NAME_REJECT = 0.78, 0.58


@dataclass(frozen=True)
class Number:
    """A field of the reference against one of the candidate; floors apply beside the shares. ``cap`` is never, component (rows) or always."""

    field: str
    base: str
    value: str
    warn: float
    critical: float
    points: tuple[float, float]
    floors: tuple[float, float] = (0.0, 0.0)
    one_sided: str = "REVIEW"
    cap: str = "never"


@dataclass(frozen=True)
class Text:
    """A text field of both sides: below ``critical`` a warning, below ``review`` or blank on one side a review."""

    field: str
    review: float
    critical: float
    points: tuple[float, float]


# Thresholds, floors and points of the rules.
TEXT_RULES = (Text("item_code", 0.95, 0.60, (3, 8)),)
CATALOGUE_RULES = (
    Number("reference_quantity", "reference_quantity", "reference_quantity", 0.05, 0.15, (16, 32), one_sided="CRITICAL", cap="component"),
    Number("bid_quantity", "reference_quantity", "bid_quantity", 0.05, 0.15, (12, 24), cap="component"),
)
PRICE_PARTS = ("price_main", "price_aux", "price_labor", "price_management", "price_profit")
FULL_RULES = (
    Text("material", 0.72, 0.45, (4, 9)),
    Text("brand", 0.80, 0.45, (4, 9)),
    Text("origin", 0.85, 0.50, (3, 8)),
    Number("quantity", "quantity", "quantity", 0.05, 0.15, (15, 28), cap="component"),
    Number("reference_quantity", "reference_quantity", "reference_quantity", 0.05, 0.15, (8, 16), cap="always"),
    Number("unit_price_total", "unit_price_total", "unit_price_total", 0.10, 0.25, (20, 35), (1e5, 1e6), cap="component"),
    Number("amount", "amount", "amount", 0.10, 0.25, (18, 32), (1e5, 1e6), cap="component"),
    *(Number(part, part, part, 0.10, 0.25, (7, 12), (1e4, 1e5), cap="always") for part in PRICE_PARTS),
)
ROW_POINTS = {"missing": ("CRITICAL", 45.0), "extra": ("WARNING", 30.0)}


def finding(field: str | Column, severity: Column, points: Column, reference: Column | None = None, candidate: Column | None = None, delta: Column | None = None, delta_pct: Column | None = None, similarity: Column | None = None) -> Column:
    """A finding where ``severity`` is not null, else null."""
    none = F.lit(None)
    said = [F.lit(field) if isinstance(field, str) else field, *(none if x is None else x for x in (reference, candidate, delta, delta_pct, similarity)), severity, points]
    names = ("field", "reference", "candidate", "delta", "delta_pct", "similarity", "severity", "points")
    return F.when(severity.isNotNull(), F.struct(*[x.alias(n) for x, n in zip(said, names)]).cast(FINDING))


def number_finding(rule: Number, r: str = "r", c: str = "c") -> Column:
    base, value = F.col(f"{r}.{rule.base}"), F.col(f"{c}.{rule.value}")
    component = (F.coalesce(F.col(f"{r}.row_type") == "component", F.lit(False)) | F.coalesce(F.col(f"{c}.row_type") == "component", F.lit(False))) if rule.cap == "component" else F.lit(rule.cap == "always")
    ceiling = F.when(component, "WARNING").otherwise("CRITICAL")
    severity = numeric_difference(base, value, rule.warn, rule.critical, *rule.floors, rule.one_sided, ceiling)
    points = F.when(severity == "CRITICAL", float(rule.points[1])).otherwise(float(rule.points[0]))
    return finding(rule.field, severity, points, base.cast("string"), value.cast("string"), value - base, percent_delta(base, value))


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def text_finding(rule: Text, r: str = "r", c: str = "c", where: Column | None = None) -> Column:
    """The finding of a text rule on normalised names; ``where`` limits the rows the rule looks at."""
    a, b = F.col(f"{r}.{rule.field}"), F.col(f"{c}.{rule.field}")
    alike = text_similarity(normalize_name(a), normalize_name(b))
    severity = F.when(blank(a) & blank(b), None).when(blank(a) | blank(b), "REVIEW").when(alike < rule.critical, "WARNING").when(alike < rule.review, "REVIEW")
    severity = severity if where is None else F.when(where, severity)
    return finding(rule.field, severity, F.when(severity == "WARNING", float(rule.points[1])).otherwise(float(rule.points[0])), a, b, similarity=alike)


def name_finding(r: str = "r", c: str = "c") -> Column:
    """Equal codes under unlike names, then a low match score, then the names themselves."""
    a, b, lexical, score = F.col(f"{r}.item_name"), F.col(f"{c}.item_name"), F.col("lexical_score"), F.col("score")
    clash = (F.col("kind") == "exact_code") & (lexical < NAME_REVIEW)
    worse = lexical < NAME_REJECT
    by_code = finding("item_name", F.when(clash, F.when(worse, "CRITICAL").otherwise("WARNING")), F.when(worse, 32.0).otherwise(20.0), a, b, similarity=lexical)
    by_score = finding("item_name", F.when(score < NAME_REVIEW, "REVIEW"), F.least(F.lit(30.0), (NAME_REVIEW - score) * 100), a, b, similarity=score)
    return F.coalesce(by_code, by_score, text_finding(Text("item_name", 0.88, 0.55, (4, 10)), r, c))


def unit_finding(r: str = "r", c: str = "c") -> Column:
    unlike = ~normalize_unit(F.col(f"{r}.unit")).eqNullSafe(normalize_unit(F.col(f"{c}.unit")))
    return text_finding(Text("unit", 0.99, 0.80, (5, 12)), r, c, unlike)


def quality_findings(flags: Column, side: str) -> Column:
    """A finding for every flag of a row; broken references, formulas and sums are critical."""
    def one(flag: Column) -> Column:
        broken = F.lower(flag).rlike("#ref|lỗi công thức|sai phép tính")
        return finding("data_quality", F.when(broken, "CRITICAL").otherwise("REVIEW"), F.when(broken, 22.0).otherwise(5.0), F.lit(side), flag)

    return F.coalesce(F.transform(flags, one), F.array().cast(f"array<{FINDING}>"))


def _technical(side: str) -> Column:
    return F.transform(F.map_entries(F.coalesce(F.col(f"{side}.technical"), F.create_map().cast("map<string,string>"))), lambda e: F.struct(normalize_name(e["key"]).alias("k"), e["key"].alias("name"), F.trim(e["value"]).alias("v")))


def _technical_names(r: str, c: str) -> Column:
    return F.array_distinct(F.concat(F.transform(_technical(r), lambda e: e["k"]), F.transform(_technical(c), lambda e: e["k"])))


def _at(side: Column, k: Column) -> Column:
    return F.get(F.filter(side, lambda e: e["k"] == k), 0)


def _word_likeness(a: Column, b: Column) -> Column:
    """1 for equal normalised texts, else the share of words that both have; made without Python, which cannot be called within lambdas."""
    x, y = (F.split(F.coalesce(normalize_name(t), F.lit("")), " ") for t in (a, b))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def technical_findings(r: str = "r", c: str = "c") -> Column:
    """A finding for every name of a technical map that differs, numbers by shares where both sides are plain numbers, else texts by their words.

    Names are normalised; of equal ones the first counts. Values with letters
    or / x % < > are no plain numbers.
    """
    a, b, at = _technical(r), _technical(c), _at
    pairs = F.transform(_technical_names(r, c), lambda k: F.struct(k.alias("k"), _word_likeness(at(a, k)["v"], at(b, k)["v"]).alias("alike")))
    number = lambda v: F.when(~v.rlike(r"[\p{L}/×%<>]"), parse_number(v))
    named = F.transform(pairs, lambda z: F.struct(F.coalesce(at(a, z["k"])["name"], at(b, z["k"])["name"]).alias("name"), at(a, z["k"])["v"].alias("x"), at(b, z["k"])["v"].alias("y"), z["alike"].alias("alike")))
    # The large expression of a number stands once a side; what follows reads fields.
    read = F.transform(named, lambda z: F.struct(z["name"].alias("name"), z["x"].alias("x"), z["y"].alias("y"), z["alike"].alias("alike"), number(z["x"]).alias("p"), number(z["y"]).alias("q")))

    def one(z: Column) -> Column:
        x, y, p, q = z["x"], z["y"], z["p"], z["q"]
        plain = p.isNotNull() & q.isNotNull()
        numeric = F.when((F.abs(percent_delta(p, q)) >= 0.05) | ((p == 0) & (q != 0)), "WARNING")
        textual = F.when(blank(x) & blank(y), None).when(blank(x) | blank(y), "REVIEW").when(z["alike"] < 0.65, "WARNING").when(z["alike"] < 0.90, "REVIEW")
        severity = F.when(plain, numeric).otherwise(textual)
        points = F.when(plain | (severity == "WARNING"), 7.0).otherwise(3.0)
        return finding(F.concat(F.lit("technical "), z["name"]), severity, points, x, y, F.when(plain, q - p), F.when(plain, percent_delta(p, q)), F.when(~plain, z["alike"]))

    return F.array_compact(F.transform(read, one))


def with_verdict(rows: DataFrame, findings: str = "findings") -> DataFrame:
    """Adds severity (the worst, OK without findings) and anomaly_score (the sum of points, 100 at most)."""
    ranks = F.transform(findings, lambda f: F.array_position(F.array(*map(F.lit, RANK)), f["severity"]))
    worst = F.element_at(F.array(*map(F.lit, RANK)), F.coalesce(F.array_max(ranks), F.lit(1)).cast("int"))
    total = F.aggregate(F.col(findings), F.lit(0.0), lambda s, f: s + f["points"])
    return rows.withColumn("severity", worst).withColumn("anomaly_score", F.least(F.lit(100.0), total))


def compare_rows(pairs: DataFrame, catalogue: bool = False, technical: bool = False) -> DataFrame:
    """Adds findings, notes, severity and anomaly_score to ``pairs(r, c, kind, score, lexical_score)``.

    ``r`` and ``c`` are structs of the same fields; a null ``c`` is a missing
    item, a null ``r`` an extra one, and such rows get that finding alone.
    ``catalogue`` compares quantities with an official list that has no prices,
    otherwise attributes, quantities and prices are compared; ``technical``
    compares maps of technical data as well. Another sheet is a note only. No shuffle: every rule looks at one row.
    """
    flags = F.concat(quality_findings(F.col("r.data_quality_flags"), "reference"), quality_findings(F.col("c.data_quality_flags"), "candidate"))
    rules = (*TEXT_RULES, *(CATALOGUE_RULES if catalogue else FULL_RULES))
    found = [name_finding(), unit_finding(), *(text_finding(x) if isinstance(x, Text) else number_finding(x) for x in rules)]
    matched = F.concat(F.array_compact(F.array(*found)), *([technical_findings()] if technical else []), flags)
    alone = {k: F.array(finding(k, F.lit(s), F.lit(p), F.col("r.item_name"), F.col("c.item_name"))) for k, (s, p) in ROW_POINTS.items()}
    findings = F.when(F.col("c").isNull(), alone["missing"]).when(F.col("r").isNull(), alone["extra"]).otherwise(matched)
    moved = F.lower("r.sheet") != F.lower("c.sheet")
    notes = F.array_compact(F.array(F.when(moved, F.concat(F.lit("other sheet: "), F.col("r.sheet"), F.lit(" / "), F.col("c.sheet")))))
    return with_verdict(pairs.withColumn("findings", findings).withColumn("notes", notes))
