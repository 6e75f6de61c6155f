"""Dossiers, document vocabularies and rounds of clarification."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import token_set_ratio
from ..functions.text import strip_accents

OK, MISSING, PARTLY, NONE = "ĐẠT", "THIẾU", "THIẾU MỘT PHẦN", "KHÔNG CÓ (không bắt buộc)"
ANSWERED, UNANSWERED, NOT_FOUND = "ĐÃ TRẢ LỜI", "CHƯA TRẢ LỜI", "KHÔNG THẤY TRONG PHẢN HỒI"
# Files that do not count, and the documents a dossier needs: key, label, patterns on folded paths, least files, required, extensions.
IGNORED = ("thumbs.db", ".ds_store", "desktop.ini")
CHECKLIST = (
    ("don_chao_gia", "Đơn chào giá / Đơn dự thầu", r"don\s*chao\s*gia|thu\s*chao\s*gia|don\s*du\s*thau", 1, True, ""),
    ("bang_chao_gia", "Bảng chào giá chi tiết / BOQ", r"\bboq\b|chao\s*gia\s*chi\s*tiet|bang\s*chao\s*gia|klmt", 1, True, "xlsx|xlsb|xls|pdf"),
    ("danh_muc_vat_tu", "Danh mục vật tư/thiết bị đề xuất (PL02)", r"danh\s*muc\s*vat\s*tu|\bdmvt\b|vat\s*tu\s*(de\s*xuat|thiet\s*bi)|pl\s*0?2", 1, True, ""),
    ("bao_cao_tai_chinh", "Báo cáo tài chính (3 năm)", r"bao\s*cao\s*tai\s*chinh|\bbctc\b", 3, True, ""),
    ("nang_luc_phap_ly", "Hồ sơ năng lực / pháp lý doanh nghiệp", r"nang\s*luc|dang\s*ky\s*doanh\s*nghiep|phap\s*ly|chung\s*chi|business\s*license|dkkd", 1, True, ""),
    ("hop_dong_tuong_tu", "Hợp đồng tương tự", r"hop\s*dong\s*tuong\s*tu|\bhdtc\b|hd\s*tuong\s*tu", 1, True, ""),
    ("nhan_su", "Nhân sự chủ chốt / sơ đồ tổ chức", r"nhan\s*su|so\s*do\s*to\s*chuc|\bcbkt\b", 1, True, ""),
    ("tien_do", "Tiến độ thi công / cung cấp", r"tien\s*do", 1, True, ""),
    ("bien_phap_thi_cong", "Biện pháp thi công", r"bien\s*phap\s*thi\s*cong|\bbptc\b", 1, True, ""),
    ("an_toan_lao_dong", "An toàn lao động / VSMT", r"an\s*toan\s*lao\s*dong|\batld\b|an\s*toan", 1, True, ""),
    ("catalogue", "Catalogue vật tư thiết bị", r"catalog", 1, False, ""),
    ("uy_quyen", "Giấy ủy quyền ký hồ sơ", r"uy\s*quyen", 1, False, ""),
)
RULES = "key string, label string, pattern string, min_count int, required boolean, extensions string"


def fold(text: Column) -> Column:
    return F.lower(strip_accents(F.coalesce(text, F.lit(""))))


def checklist(spark: SparkSession, rows=CHECKLIST) -> DataFrame:
    return spark.createDataFrame(list(rows), RULES)


def dossier_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, file) of every file below ``root`` (or roots matched by a glob), without files of the system; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    return files.where(~name.isin(*IGNORED)).select("path", name.alias("file"))


def _hits(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(bidder, path, key) of each file and rule that fit; rules are a short list."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    keyed = files.select("bidder", "path", fold(F.col("path")).alias("folded"), extension.alias("ext"))
    fits = F.expr("folded rlike pattern and (extensions = '' or array_contains(split(extensions, '[|]'), ext))")
    return keyed.join(F.broadcast(rules), fits).select("bidder", "path", "key").distinct()


def dossier_status(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(bidder, key, label, required, n_files, status) of every bidder of files(bidder, path) and every rule."""
    hits = _hits(files, rules).groupBy("bidder", "key").agg(F.count(F.lit(1)).alias("n_files"))
    grid = files.select("bidder").distinct().join(F.broadcast(rules), F.lit(True))
    out = grid.join(hits, ["bidder", "key"], "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    none = F.when(F.col("required"), MISSING).otherwise(NONE)
    status = F.when(F.col("n_files") >= F.col("min_count"), OK).when(F.col("n_files") == 0, none).otherwise(PARTLY)
    return out.select("bidder", "key", "label", "required", "n_files", status.alias("status"))


def unmatched_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    return files.select("bidder", "path").join(_hits(files, rules), ["bidder", "path"], "left_anti")


def dossier_matrix(status: DataFrame, bidders: list[str]) -> DataFrame:
    """One line a document with a status column a bidder."""
    return status.groupBy("key", "label").pivot("bidder", bidders).agg(F.first("status"))


def evidence(line: Column, limit: int = 180) -> Column:
    """A line with single spaces, without marks at its ends, cut with dots."""
    out = F.regexp_replace(F.regexp_replace(line, r"\s+", " "), r"^[ .;\-|]+|[ .;\-|]+$", "")
    return F.when(F.length(out) > limit, F.concat(F.substring(out, 1, limit), F.lit("..."))).otherwise(out)


def detect_requirements(texts: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, rule, hits, evidence): how many lines of a text name each document of rules(rule, pattern), and the first that does."""
    lines = texts.select(key, F.posexplode(F.split("text", r"[\n\r]+")).alias("pos", "line")).where(F.trim("line") != "").withColumn("folded", fold(F.col("line")))
    met = lines.join(F.broadcast(rules.select("rule", "pattern")), F.expr("folded rlike pattern"))
    return met.groupBy(key, "rule").agg(F.count(F.lit(1)).alias("hits"), F.min_by("line", "pos").alias("line")).select(key, "rule", "hits", evidence(F.col("line")).alias("evidence"))


_COLUMNS = {"stt": "stt", "content": "noi dung danh gia|noi dung", "requirement": "yeu cau", "request": "y kien cdt|y kien chu dau tu", "response": "tra loi lam ro|nha thau tra loi|phan hoi"}


def load_requests(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, row_number, stt, content, requirement, request, response) of sheets whose first 12 rows name a content and a request.

    A blank content takes that of the row above; rows without a request are left out.
    """
    keyed = cells.where("kind not in ('unreadable', 'blank')").withColumns({"t": F.trim("text"), "k": F.regexp_replace(F.trim(fold(F.col("text"))), r"\s+", " ")})
    at = [F.min(F.when(F.col("k").rlike(p), F.col("column_number"))).alias(f"at_{n}") for n, p in _COLUMNS.items()]
    heads = keyed.where("row_number <= 12").groupBy("workbook", "sheet", "row_number").agg(*at).where("at_request is not null and at_content is not null")
    heads = heads.groupBy("workbook", "sheet").agg(F.min(F.struct("row_number", *[f"at_{n}" for n in _COLUMNS])).alias("h")).select("workbook", "sheet", F.col("h.row_number").alias("head"), *[F.col(f"h.at_{n}") for n in _COLUMNS])
    of = lambda n: F.coalesce(F.max(F.when(F.col("column_number") == F.col(f"at_{n}"), F.col("t"))), F.lit("")).alias(n)
    rows = keyed.join(heads, ["workbook", "sheet"]).where("row_number > head").groupBy("workbook", "sheet", "row_number").agg(*map(of, _COLUMNS))
    order = Window.partitionBy("workbook", "sheet").orderBy("row_number").rowsBetween(Window.unboundedPreceding, 0)
    above = F.coalesce(F.last(F.nullif("content", F.lit("")), ignorenulls=True).over(order), F.lit(""))
    return rows.withColumn("content", above).where("request <> ''")


def request_key() -> Column:
    return F.regexp_replace(F.trim(fold(F.concat_ws(" ", "stt", "content", "request"))), r"\s+", " ")


def track_requests(requests: DataFrame, responses: DataFrame, least: float = 0.75) -> DataFrame:
    """(bidder, sheet, row_number, request, response, similarity, status) of every request of every bidder.

    Requests are taken in document order, each with the most alike response
    not yet taken (the first at a tie) if the token sets are alike by
    ``least``. The order decides, so a bidder's round of clarification is one
    task; rounds of bidders run side by side. Both sides have bidder, sheet,
    row_number, stt, content, request, response.
    """
    side = lambda df, k: df.select("bidder", F.lit(k).alias("k"), "sheet", "row_number", "request", "response", request_key().alias("key"))
    both = side(requests, 0).unionByName(side(responses, 1))
    schema = T.StructType([*both.select("bidder", "sheet", "row_number", "request", "response").schema.fields, T.StructField("similarity", T.DoubleType()), T.StructField("status", T.StringType())])

    def judge(frame):
        frame = frame.sort_values(["sheet", "row_number", "key"])
        asked, answers = frame[frame["k"] == 0], frame[frame["k"] == 1]
        open_, out = list(zip(answers["key"], answers["response"])), []
        for r in asked.itertuples():
            scored = [token_set_ratio(r.key, key) / 100 for key, _ in open_]
            best = max(range(len(scored)), key=lambda k: (scored[k], -k), default=None)
            found = best is not None and scored[best] >= least
            said = open_.pop(best)[1] if found else None
            status = NOT_FOUND if not found else ANSWERED if (said or "").strip() else UNANSWERED
            out.append((r.bidder, r.sheet, r.row_number, r.request, said, scored[best] if found else 0.0, status))
        return pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return both.groupBy("bidder").applyInPandas(judge, schema)
