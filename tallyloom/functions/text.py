"""Text normalisation as Column expressions; none of them leaves the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in an item name.
STOP_WORDS = ("va", "và", "cua", "của", "cho", "tai", "tại", "theo", "kem", "kèm", "bao", "gom", "gồm", "cac", "các", "hang", "hạng", "muc", "mục")
# Unit spellings and their standard form.
UNITS = {
    "cai": "cái", "cái": "cái", "chiec": "cái", "chiếc": "cái", "bo": "bộ", "bộ": "bộ", "tu": "tủ", "tủ": "tủ", "lot": "lô", "lo": "lô", "lô": "lô",
    "tb": "thiết bị", "thietbi": "thiết bị", "thiếtbị": "thiết bị", "m": "m", "met": "m", "mét": "m", "md": "m", "metdai": "m", "métdài": "m", "mét dài": "m",
    "m2": "m²", "met2": "m²", "mét2": "m²", "mvuong": "m²", "m vuong": "m²", "m vuông": "m²", "metvuong": "m²", "métvuông": "m²", "met vuong": "m²", "mét vuông": "m²",
    "m3": "m³", "met3": "m³", "mét3": "m³", "mkhoi": "m³", "m khoi": "m³", "m khối": "m³", "metkhoi": "m³", "métkhối": "m³", "met khoi": "m³", "mét khối": "m³",
    "kg": "kg", "kilogam": "kg", "kilogram": "kg", "tan": "tấn", "tấn": "tấn", "ton": "tấn", "tonne": "tấn", "l": "lít", "lit": "lít", "lít": "lít",
    "kw": "kW", "kwh": "kWh", "kv": "kV", "a": "A", "v": "V", "va": "VA", "kva": "kVA", "mva": "MVA", "mm": "mm", "cm": "cm", "dm": "dm", "km": "km",
    "mm2": "mm²", "cm2": "cm²", "dm2": "dm²", "km2": "km²", "mm3": "mm³", "cm3": "cm³", "dm3": "dm³", "km3": "km³", "100m": "100m",
}
# What must not leave with a description, and what stands for it.
REDACTIONS = (
    (r"(?i)(dự\s*án|công\s*trình|tòa\s*nhà|khu\s*đô\s*thị|chung\s*cư|khách\s*sạn|bệnh\s*viện|trường\s*học|nhà\s*máy)\s*[:\-]?\s*\S+", "[DỰ ÁN]"),
    (r"(?i)(nhà\s*thầu|công\s*ty|tập\s*đoàn|TNHH|CP|cổ\s*phần)\s*[:\-]?\s*\S+", "[NHÀ THẦU]"),
    (r"[A-Z]{2,5}-\d{4,}", "[MÃ NỘI BỘ]"),
    (r"[\w.+-]+@[\w-]+\.[\w.-]+", "[EMAIL]"),
    (r"(?:0|\+84)\d{9,10}", "[SĐT]"),
)


def _accents() -> tuple[str, str]:
    """Precomposed letters whose base is one ASCII letter, and those bases."""
    found = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(unicodedata.normalize("NFD", c)) > 1]
    found = [(c, b) for c, b in found if b.isascii()] + [("đ", "d"), ("Đ", "D")]
    return "".join(c for c, _ in found), "".join(b for _, b in found)


ACCENTED, PLAIN = _accents()


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{Mn}", "")


def normalize_text(text: Column) -> Column:
    """Lower case; x for the times sign, "phi" for the diameter sign, plain digits for powers; runs of anything but letters and digits become a space."""
    out = F.lower(F.trim(F.translate(F.coalesce(text, F.lit("")), "²³×", "23x")))
    out = F.replace(F.replace(F.replace(out, F.lit("ø"), F.lit(" phi ")), F.lit("^2"), F.lit("2")), F.lit("^3"), F.lit("3"))
    return F.trim(F.regexp_replace(out, r"[^0-9a-zA-ZÀ-ỹ]+", " "))


def normalize_name(text: Column) -> Column:
    return F.array_join(F.filter(F.split(strip_accents(normalize_text(text)), " "), lambda t: ~t.isin(*STOP_WORDS)), " ")


def normalize_code(code: Column) -> Column:
    """Upper case with - between parts; letters followed by digits are parted as well; empty for a formula."""
    raw = F.trim(F.coalesce(code, F.lit("")))
    out = F.regexp_replace(strip_accents(F.upper(raw)), r"[\s._/\\]+", "-")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "[^A-Z0-9-]", ""), "-+", "-"), "^-|-$", "")
    return F.when(F.startswith(raw, F.lit("=")), F.lit("")).otherwise(F.regexp_replace(out, "^([A-Z]+)-?([0-9]+)$", "$1-$2"))


def normalize_ordinal(value: Column) -> Column:
    raw = F.trim(F.coalesce(value, F.lit("")))
    out = F.regexp_replace(F.replace(F.upper(strip_accents(raw)), F.lit(" "), F.lit("")), r"[^A-Z0-9.\-]", "")
    return F.when(F.startswith(raw, F.lit("=")), F.lit("")).otherwise(F.regexp_replace(out, r"^[.\-]+|[.\-]+$", ""))


def ordinal_key(value: Column) -> Column:
    """Sort key under which 1.2 comes before 1.10, numbers before letters, and blanks last."""
    parts = F.filter(F.split(normalize_ordinal(value), r"[.\-]"), lambda p: p != "")
    number = lambda p: F.regexp_extract(p, r"^(\d+)", 1)
    step = lambda p: F.struct(F.when(number(p) != "", 0).otherwise(1).alias("rank"), F.coalesce(F.expr("try_cast(null as bigint)"), F.when(number(p) != "", F.try_to_number(number(p), F.lit("999999999999999999")).cast("long")), F.lit(0).cast("long")).alias("number"), F.regexp_replace(p, r"^\d+", "").alias("suffix"))
    blank = F.array(F.struct(F.lit(2).alias("rank"), F.lit(0).cast("long").alias("number"), F.lit("~").alias("suffix")))
    return F.when(F.size(parts) == 0, blank).otherwise(F.transform(parts, step))


def normalize_unit(unit: Column) -> Column:
    text = F.lower(F.trim(F.translate(F.coalesce(unit, F.lit("")), "²³×", "23x")))
    text = F.replace(F.replace(text, F.lit("^2"), F.lit("2")), F.lit("^3"), F.lit("3"))
    text = F.trim(F.regexp_replace(text, r"[^0-9a-zA-ZÀ-ỹ]+", " "))
    table = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    compact = F.replace(text, F.lit(" "), F.lit(""))
    tries = [text, compact, strip_accents(text), strip_accents(compact)]
    return F.when(text == "", "").otherwise(F.coalesce(*[F.try_element_at(table, t) for t in tries], text))


def canonical_id(sheet: Column, code: Column, name: Column, ordinal: Column, path: Column) -> Column:
    """sheet[:40]::path[:60]::(code, else name[:80], else ROW-n)::ordinal without empty parts."""
    blank = lambda c: F.when(c != "", c)
    base = F.coalesce(blank(normalize_code(code)), blank(F.substring(normalize_name(name), 1, 80)), F.concat(F.lit("ROW-"), ordinal.cast("string")))
    return F.concat_ws("::", blank(F.substring(normalize_name(sheet), 1, 40)), blank(F.substring(normalize_name(path), 1, 60)), base, ordinal.cast("string"))


def redact(text: Column) -> Column:
    for pattern, stand_in in REDACTIONS:
        text = F.regexp_replace(text, pattern, stand_in)
    return F.trim(text)


def guard_formula(text: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets an apostrophe."""
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def clean_ocr_number(text: Column) -> Column:
    """Letters that a reader confuses with digits, as digits."""
    return F.regexp_replace(F.translate(F.trim(text), "OoIl|SBD–—", "00111580--"), r"[^0-9.,\-+()]", "")
