"""One-to-one matching of the items of a reference with those of a bidder, pass after pass, each on what the ones before left open."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings
from ..functions.similarity import token_set_column, token_set_ratio, weighted_ratio
from ..functions.text import normalize_name
from .match import assign_one_to_one, keep_checkpoints, tfidf_neighbours

KEYS = ("item_id", "sheet_key", "row_number", "row_type", "structural_key", "normalized_code", "normalized_name", "normalized_unit", "normalized_path", "lexical_text", "retrieval_text", "global_text")
SCORES = ("score", "structure", "code", "lexical", "unit")
PROPOSAL = ("pair", "r_id", "c_id", "kind", *SCORES, "row_distance", "reason")


def _technical_text(technical: Column) -> Column:
    entries = F.array_sort(F.map_entries(technical))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(" ", normalize_name(e["key"]), normalize_name(e["value"]))), " ")


def match_keys(items: DataFrame, pair: str = "pair") -> DataFrame:
    """What matching looks at of comparable items: keys, the text that is compared and the texts that neighbours are found by.

    ``pair`` names the comparison an item belongs to; items of one pair alone meet.
    """
    some = lambda c: F.nullif(c, F.lit(""))
    name = lambda c: normalize_name(F.coalesce(F.col(c), F.lit("")))
    technical = _technical_text(F.col("technical")) if "technical" in items.columns else F.lit("")
    keyed = items.where("is_comparable").withColumn("sheet_key", name("sheet"))
    parts = [F.col("normalized_path"), F.col("normalized_stt"), F.col("normalized_code"), F.col("normalized_name"), F.col("normalized_unit"), name("material"), name("brand"), name("origin"), technical]
    own = F.concat_ws(" | ", *map(some, parts))
    lexical = F.concat_ws(" ", some(F.col("normalized_name")), some(name("material")), some(F.col("normalized_code")))
    keyed = keyed.withColumns({"lexical_text": lexical, "global_text": own, "retrieval_text": F.concat_ws(" | ", some(F.col("sheet_key")), own)})
    return keyed.select(F.col(pair).alias("pair"), *KEYS)


@lru_cache(maxsize=1 << 16)
def abbreviation(a: str, b: str) -> float:
    """1 if equal without spaces, or if the shorter (2 to 16 characters) spells the initials of the other; 0.9 if it spells some of them in order."""
    x, y = ("".join(c for c in t if c.isalnum()) for t in (a, b))
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    short, other = (x, b) if len(x) <= len(y) else (y, a)
    if not 2 <= len(short) <= 16:
        return 0.0
    initials = "".join(w[0] for w in other.split() if w[0].isalnum())
    if short == initials:
        return 1.0
    rest = iter(initials)
    return 0.9 if all(c in rest for c in short) else 0.0


@lru_cache(maxsize=1 << 16)
def lexical(a: str, b: str, name_a: str, name_b: str) -> float:
    """0.45 weighted, 0.40 token-set ratio and 0.15 Jaccard of names with material and code, or 0.9 of an abbreviation if that is more."""
    if not a or not b:
        return 0.0
    x, y = set(a.split()), set(b.split())
    base = 0.45 * weighted_ratio(a, b) / 100 + 0.40 * token_set_ratio(a, b) / 100 + 0.15 * len(x & y) / max(1, len(x | y))
    return max(base, 0.9 * abbreviation(name_a, name_b))


@F.pandas_udf(T.DoubleType())
def lexical_score(a: pd.Series, b: pd.Series, name_a: pd.Series, name_b: pd.Series) -> pd.Series:
    return pd.Series([lexical(*x) for x in zip(a.fillna(""), b.fillna(""), name_a.fillna(""), name_b.fillna(""))], dtype="float64")


def unit_score(a: Column, b: Column) -> Column:
    """1 for equal units, 0 for others, a half where one is unknown."""
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.5).otherwise((a == b).cast("double"))


def path_score(a: Column, b: Column) -> Column:
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.5).otherwise(token_set_column(a, b) / 100)


def sheet_score(a: Column, b: Column) -> Column:
    return F.when((a == "") | (b == ""), 0.5).when(a == b, 1.0).otherwise(token_set_column(a, b) / 100)


def reliable_code(code: Column) -> Column:
    """Codes that may be looked for on other sheets: three letters or digits, or five digits."""
    compact = F.regexp_replace(code, "[^A-Za-z0-9]", "")
    return (F.length(compact) >= 3) & ~(compact.rlike(r"^\d+$") & (F.length(compact) < 5))


def _side(df: DataFrame, mark: str, keys: list[str]) -> DataFrame:
    return df.select("pair", *keys, *[F.col(c).alias(f"{mark}_{c.replace('item_id', 'id')}") for c in KEYS if c not in keys])


def _scored(pairs: DataFrame) -> DataFrame:
    """Adds lexical, unit, structure (of paths), sheet and row_distance (null on different sheets) to joined sides."""
    r, c = (lambda f: F.col(f"r_{f}")), (lambda f: F.col(f"c_{f}"))
    return pairs.withColumns(
        {
            "lexical": lexical_score(r("lexical_text"), c("lexical_text"), r("normalized_name"), c("normalized_name")),
            "unit": unit_score(r("normalized_unit"), c("normalized_unit")),
            "structure": path_score(r("normalized_path"), c("normalized_path")),
            "sheet": sheet_score(r("sheet_key"), c("sheet_key")),
            "row_distance": F.when(r("sheet_key") == c("sheet_key"), F.abs(r("row_number") - c("row_number"))),
        }
    )


def _proposed(pairs: DataFrame, kind: str, score: Column, reason: str | Column, code: Column | None = None, structure: Column | None = None, exact: bool = False) -> DataFrame:
    out = pairs.withColumns({"kind": F.lit(kind), "score": score, "reason": F.lit(reason) if isinstance(reason, str) else reason, "code": F.lit(0.0) if code is None else code})
    if structure is not None:
        out = out.withColumn("structure", structure)
    if exact:
        out = out.withColumn("lexical", F.lit(1.0))
    return out.select(*PROPOSAL)


def _joined(r: DataFrame, c: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs of rows of equal keys. Where a key repeats on both sides only rows of equal rank or of a near row meet, see :func:`_few`."""
    kept = [*keys]
    pairs = _side(_few(r, keys), "r", [*kept, "rank__"]).join(_side(_few(c, keys), "c", [*kept, "rank__"]).withColumnRenamed("rank__", "c_rank__"), ["pair", *kept])
    for k in kept:
        pairs = pairs.withColumns({f"r_{k}": F.col(k), f"c_{k}": F.col(k)})
    return pairs.where(F.abs(F.col("rank__") - F.col("c_rank__")) <= MOST_RANKS).drop("rank__", "c_rank__")


#: Rows of one key meet where their ranks by sheet and row differ by no more than this, so a key of a third of all rows makes
#: pairs in proportion to its rows. Keys of no more rows meet in full; of longer ones the rows left open are ranked and meet again.
MOST_RANKS = 50


def _few(df: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy("pair", *keys).orderBy("sheet_key", "row_number", "item_id")
    return df.withColumn("rank__", F.row_number().over(order))


def structural_pairs(r: DataFrame, c: DataFrame) -> DataFrame:
    """Pass 1: sheet, row type and structural key."""
    pairs = _scored(_joined(r.where("structural_key <> ''"), c.where("structural_key <> ''"), ["sheet_key", "row_type", "structural_key"]))
    score = F.least(F.lit(0.99), 0.96 + 0.02 * F.col("lexical") + 0.01 * F.col("unit"))
    same = ((F.col("r_normalized_code") != "") & (F.col("r_normalized_code") == F.col("c_normalized_code"))).cast("double")
    return _proposed(pairs, "exact_structure", score, "sheet, row type and structural key", same, F.lit(1.0))


def code_pairs(r: DataFrame, c: DataFrame) -> DataFrame:
    """Pass 2: sheet, row type and code."""
    pairs = _scored(_joined(r.where("normalized_code <> ''"), c.where("normalized_code <> ''"), ["sheet_key", "row_type", "normalized_code"]))
    score = F.least(F.lit(0.99), 0.76 + 0.12 * F.col("lexical") + 0.08 * F.col("structure") + 0.04 * F.col("unit"))
    return _proposed(pairs, "exact_code", score, "code on the same sheet", F.lit(1.0))


def name_pairs(r: DataFrame, c: DataFrame) -> DataFrame:
    """Pass 3: row type and name, on any sheet."""
    pairs = _scored(_joined(r.where("normalized_name <> ''"), c.where("normalized_name <> ''"), ["row_type", "normalized_name"]))
    score = F.least(F.lit(0.995), 0.91 + 0.04 * F.col("unit") + 0.03 * F.col("structure") + 0.02 * F.col("sheet"))
    reason = F.when(F.col("row_distance").isNotNull(), "name on the same sheet").otherwise("name on another sheet")
    return _proposed(pairs, "exact_name", score, reason, exact=True)


def far_code_pairs(r: DataFrame, c: DataFrame) -> DataFrame:
    """Pass 4: row type and reliable code on any sheet, borne out by name or path, and by the unit."""
    good = (F.col("normalized_code") != "") & reliable_code(F.col("normalized_code"))
    pairs = _scored(_joined(r.where(good), c.where(good), ["row_type", "normalized_code"]))
    pairs = pairs.where(~((F.col("lexical") < 0.55) & (F.col("structure") < 0.72)) & ~((F.col("unit") == 0) & (F.col("lexical") < 0.82)))
    score = F.least(F.lit(0.97), 0.70 + 0.14 * F.col("lexical") + 0.08 * F.col("structure") + 0.05 * F.col("unit") + 0.03 * F.col("sheet"))
    return _proposed(pairs, "exact_code", score, "reliable code on another sheet", F.lit(1.0))


def near_row_pairs(r: DataFrame, c: DataFrame, settings: Settings) -> DataFrame:
    """Pass 5: the nearest rows of the same sheet and type, within reach, by name, path, unit and distance.

    Rows are put into cells of reach + 1 and look into three, so this is an
    equi-join. A row's nearest are its nearest within reach: rows farther away
    would be left out afterwards anyway.
    """
    cell = lambda c_: F.floor(F.col(c_) / (settings.row_reach + 1))
    keys = ["sheet_key", "row_type"]
    left = _side(r, "r", keys).withColumn("cell__", F.explode(F.array(*[cell("r_row_number") + k for k in (-1, 0, 1)])))
    pairs = left.join(_side(c, "c", keys).withColumn("cell__", cell("c_row_number")), ["pair", *keys, "cell__"])
    for k in keys:
        pairs = pairs.withColumns({f"r_{k}": F.col(k), f"c_{k}": F.col(k)})
    distance = F.abs(F.col("r_row_number") - F.col("c_row_number"))
    place = F.row_number().over(Window.partitionBy("pair", "r_id").orderBy("near__", "c_row_number", "c_id"))
    pairs = pairs.withColumn("near__", distance).where(F.col("near__") <= settings.row_reach).withColumn("place__", place).where(F.col("place__") <= settings.near_rows)
    near = F.greatest(F.lit(0.0), 1.0 - F.col("row_distance") / settings.row_reach)
    pairs = _scored(pairs).withColumn("score__", 0.58 * F.col("lexical") + 0.22 * F.col("structure") + 0.12 * F.col("unit") + 0.08 * near)
    return _proposed(pairs.where(F.col("score__") >= max(settings.thresholds.name_reject_score, 0.68)), "row_near", F.col("score__"), "near row of the same sheet")


def fuzzy_pairs(r: DataFrame, c: DataFrame, settings: Settings, everywhere: bool) -> DataFrame:
    """Passes 6 and 7: neighbours by character TF-IDF within a sheet and type, or within a type of all sheets."""
    block = ["pair", "row_type"] if everywhere else ["pair", "sheet_key", "row_type"]
    text = "global_text" if everywhere else "retrieval_text"
    k = max(settings.fuzzy_top_k, 8) if everywhere else settings.fuzzy_top_k
    near = tfidf_neighbours(r, c, "item_id", "item_id", text, k, block=block).select(F.col("a_id").alias("r_id"), F.col("b_id").alias("c_id"), "cosine")
    pairs = _side(r, "r", []).join(near, "r_id").join(_side(c, "c", []).drop("pair"), "c_id")
    pairs = _scored(pairs)
    x = {n: F.col(n) for n in ("cosine", "lexical", "structure", "unit", "sheet")}
    if everywhere:
        score = 0.48 * x["cosine"] + 0.32 * x["lexical"] + 0.10 * x["unit"] + 0.06 * x["structure"] + 0.04 * x["sheet"]
    else:
        score = 0.46 * x["cosine"] + 0.34 * x["lexical"] + 0.12 * x["structure"] + 0.08 * x["unit"]
    least = max(settings.thresholds.name_reject_score, 0.68) if everywhere else settings.thresholds.name_reject_score
    return _proposed(pairs.withColumn("score__", score).where(F.col("score__") >= least), "fuzzy", F.col("score__"), "similar text on any sheet" if everywhere else "similar text on the same sheet")


def proposal_order() -> list[Column]:
    """The total order of proposals, the least first: score, lexical, unit and structure from the highest, distance, and the ids."""
    return [-F.col("score"), -F.col("lexical"), -F.col("unit"), -F.col("structure"), F.coalesce("row_distance", F.lit(10**9)), F.col("r_id"), F.col("c_id")]


def best_of_pairs(proposals: DataFrame) -> DataFrame:
    """The first proposal of each pair of rows."""
    place = F.row_number().over(Window.partitionBy("r_id", "c_id").orderBy(*proposal_order(), "reason"))
    return proposals.withColumn("place__", place).where("place__ = 1").drop("place__")


def with_vectors(proposals: DataFrame, vectors_r: DataFrame, vectors_c: DataFrame) -> DataFrame:
    """Proposals re-scored by the cosine of ``vectors(item_id, vector)`` of both sides: 0.54 score, 0.36 cosine, 0.10 unit; others stay."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    a, b = F.col("r_vector"), F.col("c_vector")
    joined = proposals.join(vectors_r.select(F.col("item_id").alias("r_id"), F.col("vector").alias("r_vector")), "r_id", "left").join(vectors_c.select(F.col("item_id").alias("c_id"), F.col("vector").alias("c_vector")), "c_id", "left")
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))))
    score = F.least(F.lit(1.0), 0.54 * F.col("score") + 0.36 * F.col("semantic") + 0.10 * F.col("unit"))
    out = joined.withColumn("semantic", cosine)
    return out.withColumns({"score": F.when(F.col("semantic").isNull(), F.col("score")).otherwise(score), "kind": F.when(F.col("semantic").isNull(), F.col("kind")).otherwise("semantic")}).select(*PROPOSAL)


def match_items(reference: DataFrame, candidate: DataFrame, settings: Settings = Settings(), pair: str = "pair") -> DataFrame:
    """(pair, r_id, c_id, kind, score, structure, code, lexical, unit, row_distance, reason) of all comparable items of both sides.

    Every item stands in one row: matched with one of the other side, or alone
    as ``missing`` (no c_id) or ``extra`` (no r_id) with score 0. Passes 1 to 5
    are settled one after the other; 6 and 7 compete. Items of different
    ``pair`` (a column of both sides) never meet, so several bidders are
    matched in one run. item_id must be unique.
    """
    keep_checkpoints(reference.sparkSession)
    r, c = match_keys(reference, pair).checkpoint(), match_keys(candidate, pair).checkpoint()
    every_r, every_c, done = r, c, None
    keyed = {structural_pairs: ["sheet_key", "row_type", "structural_key"], code_pairs: ["sheet_key", "row_type", "normalized_code"], name_pairs: ["row_type", "normalized_name"], far_code_pairs: ["row_type", "normalized_code"]}
    passes = (*keyed, lambda a, b: near_row_pairs(a, b, settings), lambda a, b: best_of_pairs(fuzzy_pairs(a, b, settings, False).unionByName(fuzzy_pairs(a, b, settings, True))))
    left_out = lambda side, settled, mine: side.join(settled.select(F.col(mine).alias("item_id")), "item_id", "left_anti").select("pair", *KEYS).checkpoint()
    for step in passes:
        while True:
            settled = assign_one_to_one(step(r, c).checkpoint(), "r_id", "c_id", proposal_order())
            if settled.isEmpty():
                break
            long = step in keyed and not r.unionByName(c).groupBy("pair", *keyed[step]).count().where(F.col("count") > MOST_RANKS).isEmpty()
            done = settled if done is None else done.unionByName(settled)
            r, c = left_out(r, settled, "r_id"), left_out(c, settled, "c_id")
            if not long:
                break
    if done is None:
        done = settled
    done = done.checkpoint()
    alone = lambda every, mine, kind, reason: every.join(done.select(F.col(mine).alias("item_id")), "item_id", "left_anti").select("pair", F.col("item_id").alias(mine), F.lit(kind).alias("kind"), *[F.lit(0.0).alias(s) for s in SCORES], F.lit(reason).alias("reason"))
    out = done.unionByName(alone(every_r, "r_id", "missing", "no item of the bidder fits"), allowMissingColumns=True)
    return out.unionByName(alone(every_c, "c_id", "extra", "beside the reference"), allowMissingColumns=True)


def in_document_order(matches: DataFrame, reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Matches with sheet and row_number of the reference, extras last with those of the bidder, in that order."""
    r = reference.select(F.col("item_id").alias("r_id"), F.col("sheet").alias("rs__"), F.col("row_number").alias("rr__"))
    c = candidate.select(F.col("item_id").alias("c_id"), F.col("sheet").alias("cs__"), F.col("row_number").alias("cr__"))
    both = matches.join(r, "r_id", "left").join(c, "c_id", "left")
    both = both.withColumns({"is_extra": F.col("r_id").isNull(), "sheet": F.coalesce("rs__", "cs__"), "row_number": F.coalesce("rr__", "cr__")})
    return both.select(*matches.columns, "is_extra", "sheet", "row_number").orderBy("is_extra", "sheet", "row_number", "c_id")
