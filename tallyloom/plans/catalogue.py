"""Every registered query over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import advisor, clusters, compare, consensus, match, peer, rules
from ..sources import html, markdown

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as bidders, parts as items, the mean price of a unit as the offer."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy("l_partkey", "l_suppkey").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("offer"))


OFFERS = "offers AS (SELECT l_partkey, l_suppkey, avg(l_extendedprice / l_quantity) AS offer FROM lineitem GROUP BY ALL)"


@query(f"""WITH {OFFERS}, g AS (SELECT l_partkey, count(*) AS n, min(offer) AS low, median(offer) AS mid, max(offer) AS high,
 first(l_suppkey ORDER BY offer, l_suppkey) AS low_bidder, first(l_suppkey ORDER BY offer DESC, l_suppkey) AS high_bidder FROM offers GROUP BY 1)
SELECT l_partkey, n, round(low, 8) AS low, round(mid, 8) AS mid, round(high, 8) AS high, low_bidder, high_bidder, round((high - low) / ((abs(high) + abs(low)) / 2), 6) AS spread,
 CASE WHEN (high - low) / ((high + low) / 2) >= 0.25 AND high - low >= 500 THEN 'CRITICAL' WHEN (high - low) / ((high + low) / 2) >= 0.1 AND high - low >= 100 THEN 'WARNING' ELSE 'OK' END AS severity FROM g""")
def peer_price_spread(spark, sf_dir):
    out = peer.price_spread(offers(spark, sf_dir), "l_partkey", "l_suppkey", "offer")
    return out.select("l_partkey", "n", F.round("low", 8).alias("low"), F.round("mid", 8).alias("mid"), F.round("high", 8).alias("high"), "low_bidder", "high_bidder", F.round("spread", 6).alias("spread"), "severity")


@query(f"""WITH {OFFERS} SELECT l_partkey, l_suppkey, round(offer, 8) AS offer, round(mid, 8) AS mid, round((offer - mid) / ((abs(offer) + abs(mid)) / 2), 6) AS deviation
FROM (SELECT *, median(offer) OVER (PARTITION BY l_partkey) AS mid FROM offers)""")
def peer_price_deviation(spark, sf_dir):
    return peer.deviations(offers(spark, sf_dir), "l_partkey", "offer").select("l_partkey", "l_suppkey", F.round("offer", 8).alias("offer"), F.round("mid", 8).alias("mid"), F.round("deviation", 6).alias("deviation"))


@query(f"""WITH {OFFERS}, c AS (SELECT l_partkey, median(offer) AS center FROM offers GROUP BY 1 HAVING count(*) >= 3),
m AS (SELECT l_partkey, center, median(abs(offer - center)) AS mad FROM offers JOIN c USING (l_partkey) GROUP BY ALL)
SELECT l_partkey, l_suppkey, round((offer - center) / s, 6) AS z, CASE WHEN abs((offer - center) / s) >= 3.5 THEN 'CRITICAL' WHEN abs((offer - center) / s) >= 2.5 THEN 'WARNING' ELSE 'OK' END AS severity
FROM (SELECT *, CASE WHEN mad > 0 THEN 1.4826 * mad ELSE greatest(abs(center) * 0.01, 1.0) END AS s FROM offers JOIN m USING (l_partkey))""")
def robust_z_offers(spark, sf_dir):
    return peer.robust_z(offers(spark, sf_dir), "l_partkey", "offer").select("l_partkey", "l_suppkey", F.round("z", 6).alias("z"), "severity")


@query("""SELECT l_orderkey, l_linenumber, round(abs(l_quantity * round(l_extendedprice / l_quantity, 0) - l_extendedprice), 4) AS error FROM lineitem
WHERE abs(l_quantity * round(l_extendedprice / l_quantity, 0) - l_extendedprice) / greatest(abs(l_quantity * round(l_extendedprice / l_quantity, 0)), abs(l_extendedprice), 1.0) > 0.0001""")
def math_error_check(spark, sf_dir):
    error = numbers.math_error(F.col("l_quantity"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 0), F.col("l_extendedprice"), 0.0001)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(error, 4).alias("error")).where("error is not null")


@query("""SELECT l_returnflag, count(*) AS n, sum(CASE WHEN abs(l_extendedprice * (1 - l_discount) + l_extendedprice * l_discount - l_extendedprice) > 0.005 * l_extendedprice THEN 1 ELSE 0 END) AS wrong,
sum(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) AS without_component FROM lineitem GROUP BY 1""")
def component_sum_check(spark, sf_dir):
    total = F.col("l_extendedprice") * (1 - F.col("l_discount")) + F.col("l_extendedprice") * F.col("l_discount")
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(total - F.col("l_extendedprice")) > 0.005 * F.col("l_extendedprice")).alias("wrong"), F.count_if(F.col("l_discount") == 0).alias("without_component"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey % 7 AS kind, CAST(l_partkey % 900 + 100 AS VARCHAR) AS a, CAST(l_suppkey % 900 + 100 AS VARCHAR) AS b, CAST(l_linenumber * 11 AS VARCHAR) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE kind WHEN 0 THEN a || '.' || b || ',' || d WHEN 1 THEN a || ',' || b || '.' || d WHEN 2 THEN '(' || a || '.' || b || ')' WHEN 3 THEN a || ' ' || b || ' VND' WHEN 4 THEN '0,' || d WHEN 5 THEN 'SP' || a ELSE a || ',' || d END AS cell,
CASE kind WHEN 0 THEN CAST(a || b || '.' || d AS DOUBLE) WHEN 1 THEN CAST(a || b || '.' || d AS DOUBLE) WHEN 2 THEN -CAST(a || b AS DOUBLE) WHEN 3 THEN CAST(a || b AS DOUBLE) WHEN 4 THEN CAST('0.' || d AS DOUBLE) WHEN 5 THEN NULL ELSE CAST(a || '.' || d AS DOUBLE) END AS number FROM c""")
def parse_number_variants(spark, sf_dir):
    s = lambda c: c.cast("string")
    a, b, d = s(F.col("l_partkey") % 900 + 100), s(F.col("l_suppkey") % 900 + 100), s(F.col("l_linenumber") * 11)
    kind, j = F.col("l_partkey") % 7, F.concat
    cell = F.when(kind == 0, j(a, F.lit("."), b, F.lit(","), d)).when(kind == 1, j(a, F.lit(","), b, F.lit("."), d)).when(kind == 2, j(F.lit("("), a, F.lit("."), b, F.lit(")"))).when(kind == 3, j(a, F.lit(" "), b, F.lit(" VND")))
    cell = cell.when(kind == 4, j(F.lit("0,"), d)).when(kind == 5, j(F.lit("SP"), a)).otherwise(j(a, F.lit(","), d))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("cell")).withColumn("number", numbers.parse_number(F.col("cell")))


STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
NORMAL = "trim(regexp_replace(replace(replace(replace(lower(trim(translate({0}, '²³×', '23x'))), 'ø', ' phi '), '^2', '2'), '^3', '3'), '[^0-9a-zA-ZÀ-ỹ]+', ' ', 'g'))"
NAME = f"array_to_string(list_filter(string_split(replace(strip_accents({NORMAL}), 'đ', 'd'), ' '), lambda t: t NOT IN ({STOPS})), ' ')"


@query(f"SELECT doc_id, {NAME.format('text')} AS name FROM documents")
def normalize_name_docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.normalize_name(F.col("text")).alias("name"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim(p_brand)), '[\\s._/]+', '-', 'g'), '[^A-Z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), '^([A-Z]+)-?([0-9]+)$', '\\1-\\2') AS code FROM part""")
def normalize_code_parts(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.normalize_code(F.col("p_brand")).alias("code"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey % 50, l_linenumber, l_orderkey) AS place FROM lineitem""")
def natural_ordinal_sort(spark, sf_dir):
    """The lines of each supplier's report in natural order of their ordinals."""
    ordinal = F.concat_ws(".", (F.col("l_orderkey") % 50).cast("string"), F.col("l_linenumber").cast("string"))
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(text.ordinal_key(ordinal), "l_orderkey"))
    return read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", place.alias("place"))


@query(f"""SELECT p_partkey, left(n, 40) || '::' || left(c, 60) || '::' || left(t, 80) || '::' || p_partkey AS canonical_id FROM
(SELECT p_partkey, {NAME.format('p_type')} AS n, {NAME.format('p_brand')} AS c, {NAME.format('p_name')} AS t FROM part)""")
def canonical_id_build(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.canonical_id(F.col("p_type"), F.lit(""), F.col("p_name"), F.col("p_partkey"), F.col("p_brand")).alias("canonical_id"))


@query("""WITH a AS (SELECT p_partkey AS a_key, p_name, p_size, row_number() OVER (PARTITION BY p_name, p_size ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 2 = 0),
b AS (SELECT p_partkey AS b_key, p_name, p_size, row_number() OVER (PARTITION BY p_name, p_size ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 2 = 1)
SELECT a_key, b_key, a.p_name AS p_name FROM a JOIN b USING (p_name, p_size, k)""")
def exact_name_match(spark, sf_dir):
    """Parts of even keys as one side, of odd keys as the other."""
    part = read(spark, sf_dir, "part")
    side = lambda r, c: part.where(F.col("p_partkey") % 2 == r).select(F.col("p_partkey").alias(c), "p_name", "p_size")
    return match.equal_key_pairs(side(0, "a_key"), side(1, "b_key"), ["p_name", "p_size"], "a_key", "b_key").select("a_key", "b_key", "p_name")


@query("""SELECT DISTINCT p_partkey, l_suppkey, 0.76 + 0.12 * CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS score FROM part JOIN lineitem ON l_partkey = p_partkey""")
def exact_code_match(spark, sf_dir):
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").distinct()
    return pairs.join(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", "l_suppkey", (0.76 + 0.12 * (F.col("p_size") > 25).cast("double")).alias("score"))


@query("""SELECT a_pos, b_pos, distance, place FROM (SELECT a.o_orderkey AS a_pos, b.o_orderkey AS b_pos, abs(a.o_orderkey - b.o_orderkey) AS distance,
row_number() OVER (PARTITION BY a.o_orderkey ORDER BY abs(a.o_orderkey - b.o_orderkey), b.o_orderkey) AS place
FROM orders a JOIN orders b ON b.o_orderkey BETWEEN a.o_orderkey - 35 AND a.o_orderkey + 35 WHERE a.o_orderstatus = 'F' AND b.o_orderstatus <> 'F') WHERE place <= 8""")
def row_near_match(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    a, b = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("a_pos")), orders.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("b_pos"))
    return match.nearest_rows(a, b, "a_pos", "b_pos").select("a_pos", "b_pos", "distance", "place")


@query("""SELECT p_partkey, r_name FROM part CROSS JOIN region EXCEPT SELECT l_partkey, r_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def missing_items(spark, sf_dir):
    """Parts that no supplier of a region offers: every bidder region against the whole catalogue."""
    place = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    offered = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").distinct().join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    wanted = read(spark, sf_dir, "part").select("p_partkey").join(F.broadcast(read(spark, sf_dir, "region").select("r_name").distinct()), F.lit(True))
    return match.missing(wanted, offered, ["p_partkey", "r_name"])


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)""")
def extra_items(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return match.missing(lines, read(spark, sf_dir, "part").where("p_size <= 40"), ["p_partkey"]).select("l_orderkey", "l_linenumber")


def versions(spark, sf_dir):
    """The orders of most customers, before and after a revision of every fifth price and every seventh date class."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 10).cast("double").alias("quantity"))
    old = orders.where("o_orderkey % 11 <> 0")
    new = orders.where("o_orderkey % 13 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.round(F.col("price") * 1.1, 2)).otherwise(F.col("price")).alias("price"), F.when(F.col("o_orderkey") % 7 == 0, F.col("quantity") + 1).otherwise(F.col("quantity")).alias("quantity"))
    return compare.version_status(old, new, "o_orderkey", ["price", "quantity"])


VERSIONS = """o AS (SELECT o_orderkey, o_totalprice AS price, CAST(o_custkey % 10 AS DOUBLE) AS quantity FROM orders),
v AS (SELECT o.o_orderkey, o.price AS old_price, CASE WHEN o.o_orderkey % 5 = 0 THEN round(o.price * 1.1, 2) ELSE o.price END AS new_price, o.o_orderkey % 11 <> 0 AS i, o.o_orderkey % 13 <> 0 AS j,
 o.o_orderkey % 5 = 0 AND abs(round(o.price * 1.1, 2) - o.price) > 0.5 AS cp, o.o_orderkey % 7 = 0 AS cq FROM o),
s AS (SELECT *, CASE WHEN NOT i THEN 'added' WHEN NOT j THEN 'removed' WHEN cp OR cq THEN 'changed' ELSE 'unchanged' END AS status FROM v WHERE i OR j)"""


@query(f"WITH {VERSIONS} SELECT o_orderkey, status, CASE WHEN status <> 'changed' THEN '' WHEN cp AND cq THEN 'price,quantity' WHEN cp THEN 'price' ELSE 'quantity' END AS fields FROM s")
def full_outer_versions(spark, sf_dir):
    return versions(spark, sf_dir).select("o_orderkey", "status", F.array_join("fields", ",").alias("fields"))


@query(f"WITH {VERSIONS} SELECT field, count(*) AS n FROM (SELECT 'price' AS field FROM s WHERE status = 'changed' AND cp UNION ALL SELECT 'quantity' FROM s WHERE status = 'changed' AND cq) GROUP BY 1")
def version_change_counts(spark, sf_dir):
    return versions(spark, sf_dir).select(F.explode("fields").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {VERSIONS} SELECT o_orderkey, round(new_price - old_price, 2) AS delta FROM s WHERE i AND j ORDER BY abs(new_price - old_price) DESC, o_orderkey LIMIT 15")
def top_amount_changes(spark, sf_dir):
    delta = F.col("new_price") - F.col("old_price")
    return versions(spark, sf_dir).where(delta.isNotNull()).select("o_orderkey", F.round(delta, 2).alias("delta"), F.abs(delta).alias("size")).orderBy(F.desc("size"), "o_orderkey").limit(15).drop("size")


@query("""SELECT l_suppkey, count(*) AS n, round(avg(CASE WHEN p_size <= 10 THEN 1.0 ELSE 0 END), 6) AS match_ratio FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) >= 10 AND avg(CASE WHEN p_size <= 10 THEN 1.0 ELSE 0 END) < 0.2""")
def match_ratio_guard(spark, sf_dir):
    held = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    ratio = F.avg((F.col("p_size") <= 10).cast("double"))
    return held.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), ratio.alias("r")).where("n >= 10 and r < 0.2").select("l_suppkey", "n", F.round("r", 6).alias("match_ratio"))


@query("""SELECT l_suppkey, count(*) AS n, round(avg(CASE WHEN p_size > 24 THEN 1.0 ELSE 0 END), 6) AS extra_ratio FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) >= 20 AND avg(CASE WHEN p_size > 24 THEN 1.0 ELSE 0 END) >= 0.5""")
def scope_mismatch_guard(spark, sf_dir):
    held = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return held.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p_size") > 24).cast("double")).alias("r")).where("n >= 20 and r >= 0.5").select("l_suppkey", "n", F.round("r", 6).alias("extra_ratio"))


@query("SELECT l_shipmode, round(avg(CASE WHEN l_discount > 0 THEN 1.0 ELSE 0 END), 6) AS fill_ratio FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_discount FROM lineitem) GROUP BY 1")
def price_fill_ratio(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode")).agg(F.round(F.avg((F.col("l_discount") > 0).cast("double")), 6).alias("fill_ratio"))


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE (p_brand, p_type) IN (SELECT (p_brand, p_type) FROM part GROUP BY p_brand, p_type HAVING count(*) > 1 AND count(DISTINCT p_name) > 1)")
def duplicate_code_flag(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    twice = part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.min("p_name").alias("a"), F.max("p_name").alias("b")).where("n > 1 and a <> b")
    return part.join(twice, ["p_brand", "p_type"], "left_semi").select("p_partkey", "p_brand", "p_type")


@query("SELECT l_suppkey, round(sum(x), 2) AS total FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_extendedprice AS x FROM lineitem) GROUP BY 1")
def detail_totals_dedup(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice").distinct().groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""SELECT l_partkey, round(avg(CASE WHEN k = 0 THEN p END), 4) AS b0, round(avg(CASE WHEN k = 1 THEN p END), 4) AS b1, round(avg(CASE WHEN k = 2 THEN p END), 4) AS b2 FROM (SELECT l_partkey, l_suppkey % 3 AS k, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY 1""")
def price_matrix_pivot(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_suppkey") % 3).alias("k"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    return peer.price_matrix(lines, "l_partkey", "k", "p", [0, 1, 2]).select("l_partkey", *[F.round(F.col(str(k)), 4).alias(f"b{k}") for k in range(3)])


@query("SELECT l_returnflag AS section, l_linestatus AS part, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_sections(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").rollup(F.col("l_returnflag").alias("section"), F.col("l_linestatus").alias("part")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_partkey, section, first_line, row_number() OVER (PARTITION BY section ORDER BY first_line, l_partkey) AS place FROM (SELECT l_partkey, min(l_returnflag) AS section, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1)")
def quote_order(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_returnflag").alias("section"), F.min("l_linenumber").alias("first_line"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy("first_line", "l_partkey")))


@query("""WITH r(rule, words) AS (VALUES ('r1', ['steel', 'brushed']), ('r2', ['copper', 'plated']), ('r3', ['small', 'brass'])), t AS (SELECT p_partkey, list_distinct(string_split(lower(p_type || ' ' || p_name), ' ')) AS w FROM part),
j AS (SELECT p_partkey, rule, len(list_intersect(w, words)) / len(list_distinct(list_concat(w, words))) AS s FROM t CROSS JOIN r)
SELECT p_partkey, first(rule ORDER BY s DESC, rule) AS rule, round(max(s), 6) AS score FROM j GROUP BY 1""")
def requirement_best_match(spark, sf_dir):
    """Three requirements, a list of bounded length in the plan, against every part."""
    rules = {"r1": ["steel", "brushed"], "r2": ["copper", "plated"], "r3": ["small", "brass"]}
    w = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " "))
    parts = read(spark, sf_dir, "part").select("p_partkey", w.alias("w"))
    score = lambda ws: F.size(F.array_intersect("w", F.array(*map(F.lit, ws)))) / F.size(F.array_union("w", F.array(*map(F.lit, ws))))
    best = F.array_min(F.array(*[F.struct((-score(ws)).alias("s"), F.lit(r).alias("rule")) for r, ws in rules.items()]))
    return parts.select("p_partkey", best.alias("b")).select("p_partkey", F.col("b.rule").alias("rule"), F.round(F.abs("b.s"), 6).alias("score"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'missing_info' WHEN r_name IN ('ASIA', 'EUROPE') AND s_suppkey % 4 <> 0 THEN 'compliant' WHEN r_name IN ('ASIA', 'EUROPE') THEN 'review' ELSE 'not_allowed' END AS status
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def compliance_status(spark, sf_dir):
    held = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    allowed = F.col("r_name").isin("ASIA", "EUROPE")
    return held.select("s_suppkey", F.when(F.col("s_acctbal") < 0, "missing_info").when(allowed & (F.col("s_suppkey") % 4 != 0), "compliant").when(allowed, "review").otherwise("not_allowed").alias("status"))


def _brands(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_brand"), F.lit(" ("), F.concat(F.lit("House "), (F.col("p_size") % 9).cast("string")), F.lit(")")).alias("brand"))


BRANDS = "b AS (SELECT p_partkey, p_brand || ' (House ' || (p_size % 9) || ')' AS brand FROM part), v AS (SELECT lower(trim(regexp_extract(brand, '\\(([^)]*)\\)', 1))) AS name FROM b GROUP BY 1 HAVING count(DISTINCT brand) >= 5)"


def _vocabulary(brands):
    named = brands.select(F.explode(F.regexp_extract_all("brand", F.lit(r"\(([^)]*)\)"), F.lit(1))).alias("name"), "brand").select(F.lower(F.trim("name")).alias("name"), "brand").where("name <> ''")
    return named.groupBy("name").agg(F.count_distinct("brand").alias("n")).where("n >= 5").select("name")


@query(f"WITH {BRANDS} SELECT name FROM v")
def bidder_vocabulary(spark, sf_dir):
    return _vocabulary(_brands(spark, sf_dir))


@query(f"WITH {BRANDS} SELECT p_partkey, CASE WHEN v.name IS NOT NULL THEN trim(regexp_replace(brand, '\\(([^)]*)\\)', '')) ELSE brand END AS brand_only, coalesce(regexp_extract(CASE WHEN v.name IS NOT NULL THEN brand END, '\\(([^)]*)\\)', 1), '') AS bidder FROM b LEFT JOIN v ON lower(trim(regexp_extract(brand, '\\(([^)]*)\\)', 1))) = v.name")
def split_brand_bidder(spark, sf_dir):
    brands = _brands(spark, sf_dir).withColumn("inside", F.regexp_extract("brand", r"\(([^)]*)\)", 1))
    known = _vocabulary(brands)
    both = brands.join(known, F.lower(F.trim("inside")) == F.col("name"), "left")
    hit = F.col("name").isNotNull()
    return both.select("p_partkey", F.when(hit, F.trim(F.regexp_replace("brand", r"\(([^)]*)\)", ""))).otherwise(F.col("brand")).alias("brand_only"), F.when(hit, F.col("inside")).otherwise("").alias("bidder"))


@query("""WITH q AS (SELECT vec_id AS q_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q_id, vec_id, round(list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS cosine FROM q CROSS JOIN embeddings)
SELECT q_id, vec_id, cosine, place FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY cosine DESC, vec_id) AS place FROM s) WHERE place <= 10""")
def vector_topk(spark, sf_dir):
    """The ten nearest of all vectors for every query, the vectors whose id is divisible by 50."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("vector"))
    found = advisor.nearest_by_vector(vectors.where("record_id % 50 = 0").withColumnRenamed("record_id", "query_id"), vectors, 10, digits=6)
    return found.select(F.col("query_id").alias("q_id"), F.col("record_id").alias("vec_id"), F.col("similarity").alias("cosine"), "place")


@query("""WITH h AS (SELECT doc_id, (CASE WHEN contains(lower(text), 'license') THEN 1 ELSE 0 END) AS a, (CASE WHEN contains(lower(text), 'version') THEN 1 ELSE 0 END) AS b FROM documents),
s AS (SELECT doc_id, CASE WHEN a + b = 2 THEN 1 WHEN a + b = 1 THEN 2 END AS stage, (a + b) / 2.0 AS score FROM h WHERE a + b > 0)
SELECT doc_id, stage, score FROM s WHERE stage = (SELECT min(stage) FROM s)""")
def keyword_search_staged(spark, sf_dir):
    """All words first, any word if that finds nothing."""
    t = F.lower("text")
    hits = F.contains(t, F.lit("license")).cast("int") + F.contains(t, F.lit("version")).cast("int")
    found = read(spark, sf_dir, "documents").select("doc_id", hits.alias("h")).where("h > 0").select("doc_id", F.when(F.col("h") == 2, 1).otherwise(2).alias("stage"), (F.col("h") / 2.0).alias("score"))
    return found.join(F.broadcast(found.agg(F.min("stage").alias("stage"))), "stage").select("doc_id", "stage", "score")


@query("SELECT count(*) AS n, count(CASE WHEN p_size > 10 THEN 1 END) AS with_vector, min(p_size) AS first_year, max(p_size) AS last_year, count(DISTINCT p_brand) AS projects FROM part")
def price_db_stats(spark, sf_dir):
    return read(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") > 10).alias("with_vector"), F.min("p_size").alias("first_year"), F.max("p_size").alias("last_year"), F.count_distinct("p_brand").alias("projects"))


@query("SELECT l_partkey, round(min(l_extendedprice / l_quantity) * 0.95, 8) AS low, round(max(l_extendedprice / l_quantity) * 1.05, 8) AS high, CASE WHEN count(*) > 0 THEN 0.8 ELSE 0.0 END AS confidence FROM lineitem GROUP BY 1")
def price_band_deterministic(spark, sf_dir):
    p = F.col("l_extendedprice") / F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.min(p) * 0.95, 8).alias("low"), F.round(F.max(p) * 1.05, 8).alias("high"), F.lit(0.8).alias("confidence"))


@query(f"""WITH {OFFERS}, g AS (SELECT l_partkey, list_sort(list(offer)) AS v FROM offers GROUP BY 1) SELECT l_partkey, round(v[len(v) // 2 + 1], 8) AS upper_mid, CASE WHEN v[len(v)] / v[len(v) // 2 + 1] > 1.01 THEN 'needs_review' ELSE 'validated' END AS status FROM g""")
def upper_median_validate(spark, sf_dir):
    held = offers(spark, sf_dir).groupBy("l_partkey").agg(F.array_sort(F.collect_list("offer")).alias("v"))
    mid = peer.upper_median(F.col("v"))
    return held.select("l_partkey", F.round(mid, 8).alias("upper_mid"), F.when(F.element_at("v", -1) / mid > 1.01, "needs_review").otherwise("validated").alias("status"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[A-Z]{2,5}-\\d{4,}', '[MÃ NỘI BỘ]', 'g'), '[\\w.+-]+@[\\w-]+\\.[\\w.-]+', '[EMAIL]', 'g'), '(?:0|\\+84)\\d{9,10}', '[SĐT]', 'g')) AS safe FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)(dự\\s*án|công\\s*trình|tòa\\s*nhà|khu\\s*đô\\s*thị|chung\\s*cư|khách\\s*sạn|bệnh\\s*viện|trường\\s*học|nhà\\s*máy)\\s*[:\\-]?\\s*\\S+', '[DỰ ÁN]', 'g'), '(?i)(nhà\\s*thầu|công\\s*ty|tập\\s*đoàn|TNHH|CP|cổ\\s*phần)\\s*[:\\-]?\\s*\\S+', '[NHÀ THẦU]', 'g') AS text FROM documents)""")
def redact_egress(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("safe"))


@query("""WITH w AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\b(\\d{1,3}(?:[.,]\\d{3})+|\\d{4,9})\\b', 1), lambda x: CAST(replace(replace(x, '.', ''), ',', '') AS DOUBLE)), lambda v: v >= 1000 AND v <= 5e8 AND v NOT IN (2023, 2024, 2025, 2026, 2027)) AS p FROM pages)
SELECT page_id, len(list_distinct(p)) AS n, list_min(p) AS low, list_max(p) AS high FROM w""")
def extract_prices_html(spark, sf_dir):
    found = F.regexp_extract_all(F.regexp_replace("html", "<[^>]*>", " "), F.lit(r"\b(\d{1,3}(?:[.,]\d{3})+|\d{4,9})\b"), F.lit(1))
    values = F.transform(found, lambda x: F.translate(x, ".,", "").cast("double"))
    good = F.filter(values, lambda v: (v >= 1000) & (v <= 5e8) & ~v.isin(2023.0, 2024.0, 2025.0, 2026.0, 2027.0))
    return read(spark, sf_dir, "pages").select("page_id", good.alias("p")).select("page_id", F.size(F.array_distinct("p")).cast("long").alias("n"), F.array_min("p").alias("low"), F.array_max("p").alias("high"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), r(rule, p) AS (VALUES ('licence', '(?i)licen[sc]e'), ('rights', '(?i)rights reserved'), ('number', '[0-9]{3,}'))
SELECT doc_id, rule, count(*) AS hits FROM l JOIN r ON regexp_matches(line, p) GROUP BY ALL""")
def checklist_hits(spark, sf_dir):
    rules = (("licence", "(?i)licen[sc]e"), ("rights", "(?i)rights reserved"), ("number", "[0-9]{3,}"))
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    hit = lines.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(r)) for r, p in rules]))).alias("rule"))
    return hit.groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("hits"))


@query("""WITH r(rule, p, least) AS (VALUES ('english', '/en/', 3), ('french', '/fr/', 60), ('plain', '\\.html$', 10)), n AS (SELECT rule, least, count(page_id) AS found FROM r LEFT JOIN pages ON regexp_matches(url, p) GROUP BY ALL)
SELECT rule, found, CASE WHEN found >= least THEN 'complete' WHEN found > 0 THEN 'partial' ELSE 'missing' END AS status FROM n""")
def dossier_status(spark, sf_dir):
    rules = (("english", "/en/", 3), ("french", "/fr/", 60), ("plain", r"\.html$", 10))
    counts = read(spark, sf_dir, "pages").agg(*[F.count_if(F.col("url").rlike(p)).alias(r) for r, p, _ in rules])
    status = lambda n, least: F.when(n >= least, "complete").when(n > 0, "partial").otherwise("missing")
    return counts.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("found"), status(F.col(r), least).alias("status")) for r, _, least in rules])))


@query("""WITH u AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), a AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant')
SELECT CASE WHEN a.conv_id IS NULL THEN 'unanswered' ELSE 'answered' END AS status, count(*) AS n FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 GROUP BY 1""")
def rfi_status(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit(True).alias("met")).distinct()
    return turns.where("role = 'user'").join(answers, ["conv_id", "turn"], "left").groupBy(F.when(F.col("met"), "answered").otherwise("unanswered").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS section FROM conversations")
def forward_fill_section(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(order).alias("section"))


@query("""WITH c AS (SELECT l_partkey AS cell, l_suppkey % 4 AS engine, l_linenumber AS variant, CAST(l_quantity AS INT) % 6 AS reading, l_discount AS score FROM lineitem), g AS (SELECT cell, reading, 2 * count(DISTINCT engine) + count(DISTINCT variant) AS agreement, max(score) AS score FROM c GROUP BY ALL)
SELECT cell, reading, agreement FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY agreement DESC, score DESC, reading) AS k FROM g) WHERE k = 1""")
def ocr_vote(spark, sf_dir):
    c = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cell"), (F.col("l_suppkey") % 4).alias("engine"), F.col("l_linenumber").alias("variant"), (F.col("l_quantity").cast("int") % 6).alias("reading"), F.col("l_discount").alias("score"))
    g = c.groupBy("cell", "reading").agg((2 * F.count_distinct("engine") + F.count_distinct("variant")).alias("agreement"), F.max("score").alias("score"))
    return g.withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("agreement"), F.desc("score"), "reading"))).where("k = 1").select("cell", "reading", "agreement")


@query("""WITH c AS (SELECT *, round(l_extendedprice / l_quantity, 2) AS price FROM lineitem), e AS (SELECT *, lambda_off AS o FROM (SELECT *, [0, 1, -1] AS lambda_off FROM c))
SELECT l_orderkey, l_linenumber, list_sort(list_transform(o, lambda d: {'e': round(abs((l_quantity + d) * price - l_extendedprice) / greatest(abs(l_extendedprice), 1), 9), 'q': l_quantity + d}))[1].q AS quantity FROM e""")
def ocr_equation_pick(spark, sf_dir):
    """Of three readings of the quantity the one that fits quantity x price = amount best."""
    lines = read(spark, sf_dir, "lineitem").withColumn("price", F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2))
    option = lambda d: F.struct(F.round(F.abs((F.col("l_quantity") + d) * F.col("price") - F.col("l_extendedprice")) / F.greatest(F.abs("l_extendedprice"), F.lit(1.0)), 9).alias("e"), (F.col("l_quantity") + d).alias("q"))
    return lines.select("l_orderkey", "l_linenumber", F.array_min(F.array(*[option(d) for d in (0, 1, -1)]))["q"].alias("quantity"))


@query()
def cer_whole_texts(spark, sf_dir):
    """Character error rate over the whole texts of all items read backwards, all edits by all characters of the items."""
    b = read(spark, sf_dir, "benchmark").select(F.coalesce("text", F.lit("")).alias("a")).withColumn("r", F.reverse("a"))
    sums = b.agg(F.count(F.lit(1)).alias("cells"), F.avg((F.col("a") == F.col("r")).cast("int")).alias("exact_match"), F.sum(F.levenshtein("a", "r").cast("long")).alias("edits"), F.sum(F.greatest(F.length("a"), F.lit(1)).cast("long")).alias("chars"))
    return sums.withColumn("cer", F.col("edits") / F.greatest("chars", F.lit(1)))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def feedback_latest_wins(spark, sf_dir):
    newest = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return read(spark, sf_dir, "events").withColumn("k", newest).where("k = 1").select("user_id", "event_type", "event_id", "value")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text, lang")
def dedup_keep_first(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("text", "lang").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\\-@]') THEN '''' || text ELSE text END AS safe FROM documents")
def injection_guard(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.guard_formula(F.col("text")).alias("safe"))


@query(f"SELECT n_nationkey, {NAME.format('n_name')} AS unit FROM nation")
def normalize_units(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", text.normalize_unit(F.col("n_name")).alias("unit"))


@query("SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_quantity >= 40")
def peer_edges(spark, sf_dir):
    """Links of orders and items above the quantity threshold."""
    return read(spark, sf_dir, "lineitem").where("l_quantity >= 40").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).distinct()


@query()
def greedy_assignment(spark, sf_dir):
    """Suppliers and parts paired one to one, the dearest line first."""
    pairs = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("score"))
    return match.assign_one_to_one(pairs, "l_partkey", "l_suppkey", [-F.col("score"), F.col("l_partkey"), F.col("l_suppkey")])


@query()
def tfidf_knn(spark, sf_dir):
    """The eight nearest benchmark items of every benchmark item by character TF-IDF."""
    items = read(spark, sf_dir, "benchmark")
    return match.tfidf_neighbours(items, items, "item_id", "item_id", "text").select("a_id", "b_id", F.round("cosine", 6).alias("cosine"), "place")


@query()
def peer_clusters(spark, sf_dir):
    """Parts of one brand and type in clusters, no size class twice in one, linked to the next three by price; the longest name stands for a cluster."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).alias("bidder"), "p_name", "p_brand", "p_type", "p_retailprice")
    by_price = Window.partitionBy("p_brand", "p_type").orderBy("p_retailprice", "id")
    ahead = parts.withColumns({f"n{k}": F.struct(F.lead("id", k).over(by_price).alias("b"), F.lead("p_retailprice", k).over(by_price).alias("price")) for k in (1, 2, 3)})
    edges = ahead.select("p_brand", "p_type", F.col("id").alias("a"), "p_retailprice", F.explode(F.array("n1", "n2", "n3")).alias("n")).where("n.b is not null").select("p_brand", "p_type", "a", "n.b", (-F.abs(F.col("n.price") - F.col("p_retailprice"))).alias("score"))
    found = parts.join(clusters.clusters_within(parts, edges, "p_brand", "p_type"), "id")
    heads = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("items"), F.max_by("id", F.struct(F.length("p_name"), -F.col("id"))).alias("representative"))
    return found.join(heads, "cluster").select(F.col("id").alias("p_partkey"), "bidder", "cluster", "items", "representative")


@query()
def html_table_cells(spark, sf_dir):
    return html.html_table_cells(read(spark, sf_dir, "pages"), "page_id", "html")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_linenumber > 4 AS part_of, p_retailprice AS rp, l_extendedprice / l_quantity AS cp, CAST(p_size AS DOUBLE) AS rq, l_quantity AS cq FROM lineitem JOIN part ON p_partkey = l_partkey),
d AS (SELECT *, abs((cp - rp) / rp) AS dp, abs((cq - rq) / rq) AS dq FROM p),
f AS (SELECT l_orderkey, l_linenumber, CASE WHEN dp >= 0.25 AND abs(cp - rp) >= 100 THEN 4 WHEN dp >= 0.1 AND abs(cp - rp) >= 10 THEN 3 ELSE 0 END AS p, CASE WHEN dq >= 0.15 AND NOT part_of THEN 4 WHEN dq >= 0.05 THEN 3 ELSE 0 END AS q FROM d)
SELECT l_orderkey, l_linenumber, CASE greatest(p, q) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'WARNING' ELSE 'OK' END AS severity, CAST(CASE p WHEN 4 THEN 35 WHEN 3 THEN 20 ELSE 0 END + CASE q WHEN 4 THEN 28 WHEN 3 THEN 15 ELSE 0 END AS DOUBLE) AS anomaly_score, CAST((p > 0)::INT + (q > 0)::INT AS INTEGER) AS n_findings FROM f""")
def row_findings(spark, sf_dir):
    """Parts as the reference, lines as offers; lines past the fourth are components, whose quantities are warned of at worst."""
    kind = F.when(F.col("l_linenumber") > 4, "component").otherwise("detail")
    r = F.struct(F.lit("detail").alias("row_type"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("quantity"))
    c = F.struct(kind.alias("row_type"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"))
    pairs = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", r.alias("r"), c.alias("c"))
    price = rules.Number("price", "price", "price", 0.10, 0.25, (20, 35), (10.0, 100.0))
    quantity = rules.Number("quantity", "quantity", "quantity", 0.05, 0.15, (15, 28), cap="component")
    found = pairs.withColumn("findings", F.array_compact(F.array(rules.number_finding(price), rules.number_finding(quantity))))
    return rules.with_verdict(found).select("l_orderkey", "l_linenumber", "severity", "anomaly_score", F.size("findings").alias("n_findings"))


@query("""SELECT o_orderkey, 1 AS table_number, r.k AS row_number, c.k AS column_number, CASE WHEN r.k = 1 AND c.k = 1 THEN 'key' WHEN r.k = 1 THEN 'status' WHEN c.k = 1 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderstatus END AS text FROM orders, (VALUES (1), (2)) r(k), (VALUES (1), (2)) c(k)""")
def markdown_cells(spark, sf_dir):
    """Orders written as small Markdown tables and read again."""
    row = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), F.col("o_orderstatus"), F.lit(" |"))
    body = F.concat(F.lit("note\n| key | status |\n|---|:-:|\n"), row, F.lit("\n\n| one row alone |\n"))
    return markdown.markdown_table_cells(read(spark, sf_dir, "orders").select("o_orderkey", body.alias("body")), "o_orderkey", "body")


@query()
def peer_text_consensus(spark, sf_dir):
    """Brands and types as items, their parts as bidders, the part's name as what is said."""
    parts = read(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("item"), "p_partkey", "p_name")
    return consensus.text_consensus(parts, "item", "p_partkey", "p_name")
