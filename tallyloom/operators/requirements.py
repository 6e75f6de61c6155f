"""Requirements on brands and origins: reading them, finding an item's requirement, and whether the item complies."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import partial_ratio, ratio, token_set_ratio, weighted_ratio
from ..functions.text import normalize_text, strip_accents
from .items import folded

# Words that tell no material apart, hints by kind of material, countries and regions.
STOP_WORDS = ("he", "thong", "vat", "tu", "thiet", "bi", "cung", "lap", "dat", "va", "cua", "cho", "phan", "loai", "don", "vi", "san", "xuat", "phu", "kien")
HINTS = (
    (("tu dien ha the",), ("tu dien", "msb", "mdb")),
    (("thiet bi dong cat tu dien ha the",), ("mccb", "acb", "mcb", "rcbo", "elcb", "dong cat")),
    (("thiet bi dong cat tu dien can ho",), ("mcb", "rcbo", "elcb", "tu can ho", "aptomat")),
    (("day cap ha the", "he thong day cap ha the"), ("cap", "cable", "xlpe", "pvc", "fr", "cu/")),
    (("busway",), ("busway", "busduct", "thanh dan dien")),
    (("den chieu sang",), ("den", "lighting", "led")),
    (("cong tac o cam",), ("cong tac", "o cam", "switch", "socket")),
    (("ong luon day dien pvc", "ong luon day pvc"), ("ong", "pvc", "luon day", "conduit")),
    (("thang mang cap",), ("thang cap", "mang cap", "trunking", "ladder", "cable tray")),
    (("kim thu set",), ("kim thu set", "lightning rod", "tia tien dao")),
    (("coc tiep dia",), ("coc tiep dia", "tiep dia", "ground rod")),
    (("bom cap nuoc",), ("bom", "pump", "cap nuoc")),
    (("ong thoat nuoc upvc",), ("upvc", "thoat nuoc")),
    (("ong cap nuoc ppr",), ("ppr", "cap nuoc")),
    (("ong thep",), ("ong thep", "steel pipe")),
    (("van va phu kien",), ("van", "valve", "phu kien")),
    (("binh nong lanh",), ("binh nong lanh", "water heater")),
    (("dong ho nuoc",), ("dong ho nuoc", "water meter")),
    (("be nuoc mai",), ("be nuoc", "bon nuoc", "tank")),
    (("dieu hoa vrv",), ("vrv", "vrf", "dieu hoa")),
    (("dieu hoa cuc bo",), ("dieu hoa cuc bo", "split", "cassette")),
    (("ong dong dieu hoa",), ("ong dong", "copper pipe", "refrigerant")),
    (("ong nuoc ngung dieu hoa",), ("nuoc ngung", "condensate")),
    (("quat thong gio",), ("quat", "fan", "thong gio")),
    (("ong gio",), ("ong gio", "duct")),
    (("mieng gio van gio",), ("mieng gio", "van gio", "grille", "damper", "diffuser")),
    (("bao on ong dong",), ("bao on", "insulation", "ong dong", "nuoc ngung")),
    (("bao on ong gio",), ("bao on", "insulation", "ong gio")),
    (("ngan chay", "chen bit ngan chay"), ("ngan chay", "firestop", "chen bit")),
)
REGIONS = {
    "asia": (("asia", "chau a"), ("asia", "chau a", "vn", "viet nam", "vietnam", "china", "trung quoc", "taiwan", "dai loan", "thailand", "thai lan", "japan", "nhat ban", "korea", "han quoc", "malaysia", "singapore", "india", "an do", "indonesia", "philippines", "turkey", "tho nhi ky")),
    "europe": (("eu", "europe", "chau au"), ("eu", "europe", "chau au", "spain", "tay ban nha", "germany", "duc", "france", "phap", "italy", "y", "netherlands", "ha lan", "belgium", "bi", "austria", "ao", "poland", "ba lan")),
    "usa": (("usa", "us", "my", "hoa ky"), ("usa", "us", "united states", "my", "hoa ky")),
}
COUNTRIES = {
    "vn": "vietnam", "viet nam": "vietnam", "vietnam": "vietnam", "tq": "china", "trung quoc": "china", "china": "china", "prc": "china", "han quoc": "korea", "korea": "korea", "kr": "korea",
    "nhat": "japan", "nhat ban": "japan", "japan": "japan", "jp": "japan", "thai lan": "thailand", "thailand": "thailand", "dai loan": "taiwan", "taiwan": "taiwan",
    "my": "usa", "hoa ky": "usa", "usa": "usa", "us": "usa", "duc": "germany", "germany": "germany", "phap": "france", "france": "france", "y": "italy", "italy": "italy",
    "tay ban nha": "spain", "spain": "spain", "an do": "india", "india": "india", "malaysia": "malaysia", "singapore": "singapore", "indonesia": "indonesia",
}
OWNER, COMPLIES, LACKS, REVIEW, INHERITED = "CHỦ ĐẦU TƯ CẤP THIẾT BỊ", "PHÙ HỢP DANH SÁCH PL02", "THIẾU THÔNG TIN PL02", "CẦN THẨM ĐỊNH TƯƠNG ĐƯƠNG", "KẾ THỪA DÒNG CHA / KHÔNG KIỂM TRA TRỰC TIẾP"


def plain(text: Column) -> Column:
    return strip_accents(normalize_text(text))


def split_requirement(text: Column) -> tuple[Column, Column]:
    """(brands, origins): what stands before and after the first dash between spaces, parted at / ; and commas."""
    halves = F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+-\s+", 2)
    part = lambda t: F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), "[/;,]"), lambda x: F.trim(x)), lambda x: x != "")
    return part(F.get(halves, 0)), part(F.get(halves, 1))


def load_requirements(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, row_number, system, item_name, requirement_text, allowed_brands, allowed_origins, note) of sheets with a column of materials and one of brands or origins.

    The header is the first of 40 rows that has both. A heading "hệ thống ..."
    without a requirement names the system of the rows below it; rows without
    a requirement, or with a broken formula as one, are left out.
    """
    keyed = cells.where("kind not in ('unreadable', 'blank')").withColumns({"t": F.trim("text"), "k": plain(F.col("text"))})
    named = F.col("k").contains("thuong hieu")
    item = F.min(F.when(F.col("k").contains("vat tu") & ~named, F.col("column_number")))
    wants = F.array_sort(F.collect_set(F.when(named | (F.col("k").contains("xuat xu") & ~F.col("k").contains("vat tu")), F.col("column_number"))))
    heads = keyed.where("row_number <= 40 and column_number <= 40").groupBy("workbook", "sheet", "row_number").agg(item.alias("item"), wants.alias("wants"), F.min(F.when(F.col("k").contains("ghi chu"), F.col("column_number"))).alias("note"))
    heads = heads.where("item is not null and size(wants) > 0").groupBy("workbook", "sheet").agg(F.min(F.struct("row_number", "item", "wants", "note")).alias("h"))
    heads = heads.select("workbook", "sheet", F.col("h.row_number").alias("head"), F.col("h.item").alias("item"), F.coalesce(F.get(F.filter("h.wants", lambda c: c > F.col("h.item")), 0), F.get("h.wants", 0)).alias("want"), F.col("h.note").alias("note_at"))
    of = lambda c: F.coalesce(F.max(F.when(F.col("column_number") == F.col(c), F.col("t"))), F.lit(""))
    rows = keyed.join(heads, ["workbook", "sheet"]).where("row_number > head").groupBy("workbook", "sheet", "row_number").agg(of("item").alias("item_name"), of("want").alias("requirement_text"), of("note_at").alias("note"))
    heading = F.startswith(plain(F.col("item_name")), F.lit("he thong")) & (F.col("requirement_text") == "")
    order = Window.partitionBy("workbook", "sheet").orderBy("row_number").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where("item_name <> ''").withColumn("system", F.coalesce(F.last(F.when(heading, F.col("item_name")), ignorenulls=True).over(order), F.lit("")))
    brands, origins = split_requirement(F.col("requirement_text"))
    rows = rows.where("requirement_text <> '' and not startswith(requirement_text, '#')")
    return rows.select("workbook", "sheet", "row_number", "system", "item_name", "requirement_text", brands.alias("allowed_brands"), origins.alias("allowed_origins"), "note")


@lru_cache(maxsize=1 << 16)
def _tokens(text: str) -> frozenset[str]:
    return frozenset(w for w in re.findall("[a-z0-9]+", text) if len(w) > 1 and w not in STOP_WORDS)


@lru_cache(maxsize=1 << 12)
def _hints(name: str) -> tuple[str, ...]:
    found = (folded(h, accents=False) for keys, hints in HINTS if any(k in name for k in keys) for h in hints)
    return tuple(dict.fromkeys(h for h in found if h))


def requirement_score(item: str, name: str, system: str = "") -> float:
    """How well the folded text of an item fits the folded name of a requirement: 0.72 of its ratios, 0.28 of its words, and bonuses for hints (two at most) and for a word of the system."""
    if not item or not name:
        return 0.0
    alike = (0.35 * weighted_ratio(item, name) + 0.35 * token_set_ratio(item, name) + 0.30 * partial_ratio(item, name)) / 100
    a, b = _tokens(item), _tokens(name)
    hits = sum(f" {h} " in f" {item} " for h in _hints(name))
    return min(1.0, 0.72 * alike + 0.28 * len(a & b) / max(1, len(a | b)) + 0.14 * min(2, hits) + 0.05 * bool(a & _tokens(system)))


def best_requirements(items: DataFrame, requirements: DataFrame, least: float = 0.66, key: str = "item_id", most: int = 20_000) -> DataFrame:
    """(key, place, match_score) of the requirement of highest score for each item that reaches ``least``, the first in document order at a tie.

    Requirements are a short list kept by people (``most`` at most, else an
    error): it is sent to all tasks and every distinct item text is scored once.
    """
    listed = requirements.orderBy("workbook", "sheet", "row_number").select("item_name", "system").limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError(f"more than {most} requirements")
    prepared = items.sparkSession.sparkContext.broadcast([(folded(r["item_name"] or "", accents=False), folded(r["system"] or "", accents=False)) for r in listed])
    text = plain(F.concat_ws(" | ", *[F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit("")) for c in ("item_name", "material", "item_code", "normalized_path")]))
    keyed = items.select(key, text.alias("t"))

    def run(frames):
        for frame in frames:
            scored = [max(((requirement_score(t, n, s), -k) for k, (n, s) in enumerate(prepared.value)), default=(0.0, 0)) for t in frame["t"]]
            yield pd.DataFrame({"t": frame["t"], "place": [-k for _, k in scored], "match_score": [s for s, _ in scored]})

    found = keyed.select("t").distinct().mapInPandas(run, "t string, place int, match_score double").where(F.col("match_score") >= least)
    return keyed.join(found, "t").select(key, "place", "match_score")


@lru_cache(maxsize=1 << 16)
def same_maker(said: str, allowed: str) -> bool:
    """Whether one folded text holds the other, or they are alike by 82 of 100 whole or 90 in part."""
    if not said or not allowed:
        return False
    return said in allowed or allowed in said or ratio(said, allowed) >= 82 or partial_ratio(said, allowed) >= 90


@lru_cache(maxsize=1 << 12)
def country(text: str) -> str:
    """One name of a country; names of three letters and more may stand within a text, the longest first."""
    if text in COUNTRIES:
        return COUNTRIES[text]
    return next((COUNTRIES[t] for t in sorted(COUNTRIES, key=len, reverse=True) if len(t) >= 3 and t in text), "") if text else ""


def origin_allowed(said: str, allowed: list[str]) -> bool:
    for a in allowed if said else ():
        inside = any(a in names and any(m in said for m in members) for names, members in REGIONS.values())
        if same_maker(said, a) or inside or (country(a) and country(a) == country(said)):
            return True
    return False


def compliance(brand: str, origin: str, more: list[str], requirement: str, brands: list[str], origins: list[str]) -> tuple[str, list[tuple[str, str]]]:
    """(status, issues) of an offered brand and origin; ``more`` are the texts beside the brand in which a maker may stand."""
    if any(w in folded(requirement, accents=False) for w in ("cdt cap", "chu dau tu cap")):
        return OWNER, []
    brand, origin = (brand or "").strip(), (origin or "").strip()
    whole = folded(" | ".join(t for t in [brand, *more] if t), accents=False)
    issues = []
    if brands and not any(same_maker(whole, folded(b, accents=False)) for b in brands):
        issues.append(("brand", f"brand '{brand}' is not listed ({'/'.join(brands)})" if brand else "brand is missing"))
    if origins and not origin_allowed(folded(origin, accents=False) or whole, [folded(o, accents=False) for o in origins]):
        issues.append(("origin", f"origin '{origin}' is not listed ({'/'.join(origins)})" if origin else "origin is missing"))
    lacking = any(text.endswith("is missing") for _, text in issues)
    return (LACKS if lacking else REVIEW) if issues else COMPLIES, issues


def with_compliance(rows: DataFrame) -> DataFrame:
    """Adds status and issues (field, message, severity, points) to rows(row_type, brand, origin, material, note, technical, requirement_text, allowed_brands, allowed_origins).

    Rows without a requirement have a null status; a component without brand
    and origin inherits from its detail and is not judged.
    """
    said = F.concat(F.array(F.col("material"), F.col("note")), F.coalesce(F.map_values("technical"), F.array().cast("array<string>")))

    @F.pandas_udf("status string, issues array<struct<field:string,message:string,severity:string,points:double>>")
    def judged(kind: pd.Series, brand: pd.Series, origin: pd.Series, more: pd.Series, text: pd.Series, brands: pd.Series, origins: pd.Series) -> pd.DataFrame:
        out = []
        for k, b, o, m, t, bs, os_ in zip(kind, brand, origin, more, text, brands, origins):
            if t is None:
                out.append((None, []))
            elif k == "component" and not (b or o):
                out.append((INHERITED, []))
            else:
                status, issues = compliance(b, o, [x for x in m if x], t, list(bs), list(os_))
                out.append((status, [(f, x, *(("WARNING", 14.0) if x.endswith("is missing") else ("REVIEW", 7.0))) for f, x in issues]))
        names = ("field", "message", "severity", "points")
        return pd.DataFrame({"status": [s for s, _ in out], "issues": [[dict(zip(names, i)) for i in x] for _, x in out]})

    out = rows.withColumn("judged__", judged("row_type", "brand", "origin", said, "requirement_text", "allowed_brands", "allowed_origins"))
    return out.withColumns({"status": F.col("judged__.status"), "issues": F.col("judged__.issues")}).drop("judged__")


def apply_requirements(items: DataFrame, requirements: DataFrame, anchor: str = "canonical_id", least: float = 0.66) -> DataFrame:
    """Items with requirement, match_score, status and issues; the requirement is looked for once an ``anchor``, by its first row."""
    first = items.groupBy(anchor).agg(F.min_by(F.struct("item_name", "material", "item_code", "normalized_path"), F.struct("sheet", "row_number")).alias("x")).select(anchor, "x.*")
    place = F.row_number().over(Window.orderBy("workbook", "sheet", "row_number")) - 1
    listed = requirements.withColumn("place", place).select("place", F.col("item_name").alias("requirement"), "requirement_text", "allowed_brands", "allowed_origins")
    found = best_requirements(first, requirements, least, anchor).join(F.broadcast(listed), "place").drop("place")
    return with_compliance(items.join(found, anchor, "left"))


def outcome_counts(rows: DataFrame) -> DataFrame:
    """One row: matched, compliant, review, missing_info, unmapped, skipped_components."""
    status = F.col("status")
    n = lambda c: F.count_if(c)
    return rows.agg(n(status.isNotNull()).alias("matched"), n(status.isin(OWNER, COMPLIES)).alias("compliant"), n(status == REVIEW).alias("review"), n(status == LACKS).alias("missing_info"), n(status.isNull()).alias("unmapped"), n(status == INHERITED).alias("skipped_components"))
