"""Registered queries that apply the operators on bids to the driver's tables, with the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advisor, documents, flows, items, matcher, ocr, quotes, requirements
from .catalogue import query, read


@query("""WITH t AS (SELECT o_orderkey AS r, o_orderstatus AS sheet, CASE WHEN o_orderkey % 17 = 0 THEN 0 WHEN o_orderkey % 7 = 0 THEN 2 WHEN o_orderkey % 5 = 0 THEN 3 END AS level FROM orders),
k AS (SELECT *, CASE WHEN level IS NOT NULL THEN 'group' WHEN r % 3 = 0 THEN 'detail' ELSE 'component' END AS kind FROM t),
w AS (SELECT *, max(CASE WHEN level = 0 THEN r END) OVER p AS l0, max(CASE WHEN level = 2 THEN r END) OVER p AS l2, max(CASE WHEN level = 3 THEN r END) OVER p AS l3, max(CASE WHEN kind = 'detail' THEN r END) OVER p AS d, max(CASE WHEN kind = 'group' THEN r END) OVER p AS g
FROM k WINDOW p AS (PARTITION BY sheet ORDER BY r ROWS UNBOUNDED PRECEDING))
SELECT r AS o_orderkey, concat_ws('/', 'N' || l0, CASE WHEN l2 > coalesce(l0, -1) THEN 'N' || l2 END, CASE WHEN l3 > greatest(coalesce(l0, -1), coalesce(l2, -1)) THEN 'N' || l3 END, CASE WHEN kind = 'component' AND d > coalesce(g, -1) THEN 'N' || d END) AS path FROM w""")
def section_stack(spark, sf_dir):
    """Orders of a status as the rows of a sheet: headings of three levels, details and components."""
    k = F.col("o_orderkey")
    level = F.when(k % 17 == 0, 0).when(k % 7 == 0, 2).when(k % 5 == 0, 3)
    rows = read(spark, sf_dir, "orders").select(k.alias("row_number"), F.col("o_orderstatus").alias("sheet"), level.alias("level"), F.concat(F.lit("N"), k.cast("string")).alias("item_name"), k.cast("string").alias("normalized_stt"), F.lit("").alias("item_code"))
    rows = rows.withColumn("row_type", F.when(F.col("level").isNotNull(), "group").when(F.col("row_number") % 3 == 0, "detail").otherwise("component"))
    return items.with_sections(rows, "sheet").select(F.col("row_number").alias("o_orderkey"), F.array_join("section_path", "/").alias("path"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 1 THEN 'A' WHEN 2 THEN '1.2' WHEN 3 THEN '' ELSE 'II.' END AS stt, CASE WHEN l_partkey % 3 = 0 THEN 'm' ELSE '' END AS unit, CASE WHEN l_suppkey % 4 = 0 THEN 'TỔNG CỘNG' ELSE 'Item' END AS name,
CASE WHEN l_partkey % 5 = 0 THEN l_quantity END AS q, CASE WHEN l_partkey % 2 = 0 THEN l_extendedprice END AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN unit = '' AND stt = '' AND name = 'TỔNG CỘNG' AND a IS NOT NULL THEN 'summary' WHEN unit = '' AND q IS NULL AND a IS NOT NULL AND stt IN ('A', 'II.') THEN 'summary'
WHEN unit = '' AND q IS NULL AND a IS NULL THEN 'group' WHEN stt <> '' THEN 'detail' ELSE 'component' END AS row_type,
CASE WHEN unit = '' AND q IS NULL AND a IS NULL THEN CASE stt WHEN 'A' THEN 0 WHEN 'II.' THEN 1 WHEN '1.2' THEN 3 ELSE 3 END END AS level FROM t""")
def row_typing(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber") % 4
    none = F.lit(None).cast("double")
    rows = lines.select("l_orderkey", "l_linenumber", F.when(n == 1, "A").when(n == 2, "1.2").when(n == 3, "").otherwise("II.").alias("stt"), F.when(F.col("l_partkey") % 3 == 0, "m").otherwise("").alias("unit"), F.when(F.col("l_suppkey") % 4 == 0, "TỔNG CỘNG").otherwise("Item").alias("item_name"), F.when(F.col("l_partkey") % 5 == 0, F.col("l_quantity")).alias("bid_quantity"), none.alias("reference_quantity"), none.alias("unit_price_total"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_extendedprice")).alias("raw_bid_amount"), none.alias("raw_reference_amount"))
    return items.typed(rows).select("l_orderkey", "l_linenumber", "row_type", "level")


@query("""WITH l AS (SELECT r_name AS bidder, p_brand AS sheet, CASE WHEN p_size > 40 THEN 1 ELSE 0 END AS section, l_extendedprice AS a, CASE WHEN l_tax > 0.02 THEN l_extendedprice * (1 - l_discount) END AS b
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT part, sheet, bidder, round(x, 2) AS by_reference, round(y, 2) AS offered FROM (SELECT 'A' AS part, sheet, bidder, sum(a) AS x, coalesce(sum(b), 0) AS y FROM l WHERE section = 0 GROUP BY GROUPING SETS ((bidder, sheet), (bidder))
UNION ALL SELECT 'B', NULL, bidder, sum(a), coalesce(sum(b), 0) FROM l WHERE section = 1 GROUP BY bidder UNION ALL SELECT 'C', NULL, bidder, sum(a), coalesce(sum(b), 0) FROM l GROUP BY bidder)""")
def roll_up_abc(spark, sf_dir):
    """Regions as bidders, brands as sheets, large parts as work beside the reference."""
    place = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("bidder"))
    lines = read(spark, sf_dir, "lineitem").join(place, "l_suppkey").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.select("bidder", F.col("p_brand").alias("sheet"), (F.col("p_size") > 40).cast("int").alias("section"), F.col("l_extendedprice").alias("reference_amount"), F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("bid_amount"))
    out = quotes.roll_up(lines)
    return out.select("part", "sheet", "bidder", F.round("by_reference", 2).alias("by_reference"), F.round("offered", 2).alias("offered"))


@query("""WITH h AS (SELECT l_orderkey AS q, CASE l_linenumber % 3 WHEN 0 THEN 'm' WHEN 1 THEN ' M ' ELSE 'kg' END AS u, CASE l_orderkey % 2 WHEN 0 THEN 'm' ELSE 'Kg' END AS w, l_extendedprice AS p FROM lineitem), s AS (SELECT q, CASE WHEN lower(trim(u)) = lower(trim(w)) AND p > 0 THEN p END AS p FROM h)
SELECT q AS query_id, count(p) AS n, round(min(p) * 0.95, 6) AS min_price, round(max(p) * 1.05, 6) AS max_price, round(avg(p), 6) AS suggested, CASE WHEN count(p) > 0 THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM s GROUP BY q""")
def price_band_by_unit(spark, sf_dir):
    n = F.col("l_linenumber") % 3
    hits = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.when(n == 0, "m").when(n == 1, " M ").otherwise("kg").alias("unit"), F.when(F.col("l_orderkey") % 2 == 0, "m").otherwise("Kg").alias("query_unit"), F.col("l_extendedprice").alias("unit_price"))
    out = advisor.price_band(hits)
    return out.select("query_id", "n", *[F.round(c, 6).alias(c) for c in ("min_price", "max_price", "suggested")], "confidence")


@query("""WITH h AS (SELECT l_orderkey AS q, list_sort(list(l_extendedprice)) AS p FROM lineitem WHERE l_orderkey % 3 <> 0 AND l_extendedprice > 0 GROUP BY 1),
s AS (SELECT o_orderkey AS q, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN -1.0 ELSE o_totalprice END AS price, o_totalprice * 0.5 AS low, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * 0.4 ELSE o_totalprice * 0.9 END AS high, (o_orderkey % 10) / 10.0 AS c FROM orders),
j AS (SELECT s.*, p[len(p) // 2 + 1] AS mid FROM s LEFT JOIN h USING (q)), k AS (SELECT *, CASE WHEN mid IS NULL AND c > 0.5 THEN 0.5 ELSE c END AS d FROM j)
SELECT q AS query_id, round(mid, 6) AS reference_median, d AS confidence, concat_ws(';', CASE WHEN price IS NULL THEN 'no price' END, CASE WHEN price <= 0 THEN 'invalid price' END, CASE WHEN low > high THEN 'reversed band' END, CASE WHEN price < low * 0.95 THEN 'below the band' END, CASE WHEN price > high * 1.05 THEN 'above the band' END,
CASE WHEN mid IS NOT NULL AND price > 0 AND (price / mid > 3 OR price / mid < 1.0 / 3) THEN 'far from past prices' END, CASE WHEN mid IS NULL AND c > 0.5 THEN 'no past prices' END, CASE WHEN d < 0.4 THEN 'low confidence' END) AS issues FROM k""")
def suggestion_checks(spark, sf_dir):
    k, total = F.col("o_orderkey"), F.col("o_totalprice")
    said = read(spark, sf_dir, "orders").select(k.alias("query_id"), F.when(k % 11 == 0, None).when(k % 13 == 0, -1.0).otherwise(total).alias("suggested_price"), (total * 0.5).alias("min_price"), F.when(k % 7 == 0, total * 0.4).otherwise(total * 0.9).alias("max_price"), ((k % 10) / 10.0).alias("confidence"))
    hits = read(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("query_id"), F.col("l_extendedprice").alias("unit_price"))
    out = advisor.validate_suggestions(said, hits)
    return out.select("query_id", F.round("reference_median", 6).alias("reference_median"), "confidence", F.array_join("issues", ";").alias("issues"))


_RULES = (("english", "English pages", "/en/", 3, True, ""), ("plain", "Plain pages", r"\.html?$", 2, False, "html|htm"), ("numbers", "Numbered", "/[0-9]+", 1000000, True, ""), ("none", "Nothing", "no such path", 1, True, ""))


@query("""WITH f AS (SELECT regexp_extract(url, '([a-z]+)(?:/|$)', 1) AS bidder, coalesce(url, '') AS path FROM pages), r(key, label, pattern, least, required, ext) AS (VALUES ('english', 'English pages', '/en/', 3, true, ''), ('plain', 'Plain pages', '\\.html?$', 2, false, 'html|htm'), ('numbers', 'Numbered', '/[0-9]+', 1000000, true, ''), ('none', 'Nothing', 'no such path', 1, true, '')),
h AS (SELECT DISTINCT bidder, path, key FROM f JOIN r ON regexp_matches(lower(path), pattern) AND (ext = '' OR lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN ('html', 'htm'))),
n AS (SELECT b.bidder, r.key, r.required, r.least, count(h.path) AS n_files FROM (SELECT DISTINCT bidder FROM f) b CROSS JOIN r LEFT JOIN h ON h.bidder = b.bidder AND h.key = r.key GROUP BY ALL)
SELECT bidder, key, n_files, CASE WHEN n_files >= least THEN 'ĐẠT' WHEN n_files = 0 AND required THEN 'THIẾU' WHEN n_files = 0 THEN 'KHÔNG CÓ (không bắt buộc)' ELSE 'THIẾU MỘT PHẦN' END AS status FROM n""")
def dossier_by_rules(spark, sf_dir):
    """Pages as files, a word of their address as the bidder."""
    files = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "([a-z]+)(?:/|$)", 1).alias("bidder"), F.coalesce("url", F.lit("")).alias("path"))
    return documents.dossier_status(files, documents.checklist(spark, _RULES)).select("bidder", "key", "n_files", "status")


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split_regex(text, '[\n\r]+') AS s FROM documents)), r(rule, p) AS (VALUES ('licence', 'licen[sc]e'), ('rights', 'rights\s+reserved'), ('number', '[0-9]{3,}')),
m AS (SELECT doc_id, rule, count(*) AS hits, arg_min(line, pos) AS line FROM l JOIN r ON regexp_matches(lower(line), p) WHERE trim(line, ' ') <> '' GROUP BY ALL), e AS (SELECT doc_id, rule, hits, regexp_replace(regexp_replace(line, '\s+', ' ', 'g'), '^[ .;\-|]+|[ .;\-|]+$', '', 'g') AS x FROM m)
SELECT doc_id, rule, hits, CASE WHEN length(x) > 180 THEN left(x, 180) || '...' ELSE x END AS evidence FROM e""")
def required_documents(spark, sf_dir):
    rules = spark.createDataFrame([("licence", "licen[sc]e"), ("rights", r"rights\s+reserved"), ("number", "[0-9]{3,}")], "rule string, pattern string")
    return documents.detect_requirements(read(spark, sf_dir, "documents"), rules, "doc_id")


@query("""WITH b AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey - lag(o_orderkey) OVER w > 3000 THEN 1 ELSE 0 END AS x FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), g AS (SELECT *, sum(x) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line FROM b)
SELECT o_custkey, line, avg(o_orderkey) AS o_orderkey FROM g GROUP BY ALL""")
def line_positions(spark, sf_dir):
    return ocr.merged_positions(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3000)


@query("""WITH c AS (SELECT l_orderkey, l_partkey % 3 AS cell, l_suppkey % 4 AS engine, l_linenumber AS variant, 'R' || (CAST(l_quantity AS INT) % 4) AS t, 0.5 + l_discount AS conf FROM lineitem), g AS (SELECT l_orderkey, cell, lower(t) AS k, t, max(conf) AS conf, 2 * count(DISTINCT engine) + count(DISTINCT variant) AS agreement FROM c GROUP BY ALL),
s AS (SELECT *, round(least(0.999, conf + least(0.16, 0.025 * (agreement - 1))), 9) AS score FROM g) SELECT l_orderkey, cell, t AS text, score AS confidence, agreement FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, cell ORDER BY agreement DESC, score DESC, length(k) DESC, t DESC) AS place FROM s) WHERE place = 1""")
def reading_votes(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    readings = lines.select("l_orderkey", (F.col("l_partkey") % 3).alias("cell"), (F.col("l_suppkey") % 4).alias("engine"), F.col("l_linenumber").alias("variant"), F.concat(F.lit("R"), (F.col("l_quantity").cast("int") % 4).cast("string")).alias("text"), (0.5 + F.col("l_discount")).alias("confidence"))
    return ocr.vote(readings, "l_orderkey", "cell").withColumn("confidence", F.round("confidence", 9))


@query("""SELECT p_partkey, string_split(p_brand || '/' || p_type, '/') AS brands, CASE WHEN p_size % 3 = 0 THEN ['N' || (p_size % 5), 'EU'] ELSE [] END AS origins FROM part""")
def requirement_split(spark, sf_dir):
    text = F.concat("p_brand", F.lit(" / "), "p_type", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" - N"), (F.col("p_size") % 5).cast("string"), F.lit(" ; EU,"))).otherwise(""))
    brands, origins = requirements.split_requirement(text)
    return read(spark, sf_dir, "part").select("p_partkey", brands.alias("brands"), origins.alias("origins"))


_UNITS = ("M2", "m²", "Mét vuông", "cái", "CHIEC", "bộ ", "kg", "tấn", "lít", "m^3", "thing", "")


@query("""SELECT l_orderkey, l_linenumber, ['m²', 'm²', 'm²', 'cái', 'cái', 'bộ', 'kg', 'tấn', 'lít', 'm³', 'thing', ''][1 + (l_partkey % 12)] AS unit FROM lineitem""")
def unit_spellings(spark, sf_dir):
    from ..functions.text import normalize_unit

    spelled = F.get(F.array(*map(F.lit, _UNITS)), (F.col("l_partkey") % 12).cast("int"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", normalize_unit(spelled).alias("unit"))


@query("""SELECT l_suppkey AS bidder, avg(CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_partkey % 3 = 0 THEN 1.0 ELSE 0.0 END END) AS fill_ratio FROM lineitem GROUP BY 1""")
def offer_fill_ratio(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("bidder"), F.when(F.col("l_linenumber") % 2 == 0, "detail").otherwise("group").alias("row_type"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_extendedprice")).alias("unit_price_total"), F.lit(None).cast("double").alias("bid_amount"))
    return flows.price_fill_ratio(rows).select("bidder", "fill_ratio")


@query("""WITH q AS (SELECT p_partkey AS q, string_split(p_name, ' ') AS w FROM part WHERE p_partkey % 50 = 0), n AS (SELECT p_partkey AS r, lower(p_name) AS n FROM part),
m AS (SELECT q, r, len(list_filter(w, lambda x: contains(n, x))) AS hit, len(list_distinct(w)) AS size, len(list_distinct(list_filter(w, lambda x: contains(n, x)))) AS dhit, len(w) AS k FROM q CROSS JOIN n), s AS (SELECT q, r, CASE WHEN hit = k THEN 1 WHEN hit > 0 THEN 2 END AS stage, dhit / size AS similarity FROM m),
f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY r) AS seen FROM (SELECT *, min(stage) OVER (PARTITION BY q) AS best FROM s WHERE stage IS NOT NULL) WHERE stage = best)
SELECT q AS query_id, r AS record_id, stage, round(similarity, 6) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, r) AS place FROM f WHERE seen <= CASE WHEN stage = 1 THEN 100 ELSE 500 END) WHERE place <= 5""")
def keyword_search_ranked(spark, sf_dir):
    """The five best records by words for every query, the parts whose key is divisible by 50."""
    part = read(spark, sf_dir, "part")
    records = part.select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("item_name"), F.lit("").alias("material_spec"))
    found = advisor.keyword_search(part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text")), records)
    return found.withColumn("similarity", F.round("similarity", 6))


@query()
def vector_neighbours(spark, sf_dir):
    """The ten nearest vectors of every query by blocks of queries, the vectors whose id is divisible by 50."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("vector"))
    return advisor.nearest_by_vector(vectors.where("record_id % 50 = 0").withColumnRenamed("record_id", "query_id"), vectors, 10)


@query()
def market_price_pages(spark, sf_dir):
    """Prices by currency marks and price words in the text of pages, without phone numbers."""
    plain = F.array(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "))
    return read(spark, sf_dir, "pages").select("page_id", advisor.prices_in(plain).alias("prices"))


def _part_items(spark, sf_dir, bid: bool):
    """Parts as item rows: brands as sheets; an offer has other names for every fifth and lacks every eleventh."""
    p = read(spark, sf_dir, "part")
    name = F.when(F.lit(bid) & (F.col("p_partkey") % 5 == 0), F.concat("p_name", F.lit(" new"))).otherwise(F.col("p_name"))
    rows = p.where((F.col("p_partkey") % 11 != 0) | F.lit(not bid))
    code = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    return rows.select(F.concat(F.lit("b" if bid else "r"), F.col("p_partkey").cast("string")).alias("item_id"), F.lit(True).alias("is_comparable"), F.col("p_brand").alias("sheet"), F.col("p_partkey").cast("long").alias("row_number"), F.lit("detail").alias("row_type"), F.lit("").alias("structural_key"), F.upper(code).alias("normalized_code"), F.lit("").alias("normalized_stt"), F.lower(F.concat_ws(" ", name, F.col("p_partkey").cast("string"))).alias("normalized_name"), F.lit("m").alias("normalized_unit"), F.lit("").alias("normalized_path"), F.lit("").alias("material"), F.lit("").alias("brand"), F.lit("").alias("origin"), F.lit("all").alias("pair"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'missing' ELSE 'exact_code' END AS kind FROM part""")
def match_flow(spark, sf_dir):
    """All passes of the matcher over parts: a code on the same sheet decides, the rest is missing."""
    found = matcher.match_items(_part_items(spark, sf_dir, False), _part_items(spark, sf_dir, True))
    return found.select(F.substring("r_id", 2, 20).cast("long").alias("p_partkey"), "kind")
