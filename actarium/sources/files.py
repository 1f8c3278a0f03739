"""A8, A9, A16-A18 - file names, audits, retention, usage and reconciliation of stored files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ColumnLike, filled, text


def safe_filename(url: ColumnLike, title: ColumnLike) -> Column:
    """A8 - name of the stored file: last path part of the address, else the title; years with extra digits are cut."""
    path = F.regexp_replace(F.regexp_replace(text(url), r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*", "")
    raw = F.try_url_decode(F.replace(F.substring_index(path, "/", -1), F.lit("+"), F.lit("%2B")))
    name = F.when(F.contains(text(raw), F.lit(".")), raw).otherwise(text(title))
    name = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_.\-]+", "_"), "^_+|_+$", "")
    name = F.regexp_replace(name, r"\b(2\d{3})\d+\b", "$1")
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(F.coalesce(F.nullif(name, F.lit("")), F.lit("edicao")), F.lit(".pdf")))


def storage_partition(pub_date: ColumnLike) -> Column:
    """A8 - struct(year, month) folder."""
    d = text(pub_date)
    has = F.length(d) > 0
    return F.struct(F.when(has, F.substring(d, 1, 4)).otherwise("sem-data").alias("year"), F.when(has, F.substring(d, 6, 2)).otherwise("00").alias("month"))


def audit_files(files: DataFrame) -> DataFrame:
    """A9 - verdict per file (path, length, content): PDF header, at least 50 bytes, end mark in the last 1024 bytes."""
    n = F.length("content")
    tail = F.substring(F.col("content"), F.greatest(n - 1023, F.lit(1)), F.lit(1024))
    reason = (
        F.when(n == 0, "empty").when(F.substring("content", 1, 5) != F.encode(F.lit("%PDF-"), "UTF-8"), "no_header").when(n < 50, "too_small")
        .when(F.position(F.lit("2525454F46"), F.hex(tail)) == 0, "no_end_mark").otherwise("ok"))
    return files.select("path", F.col("length").alias("bytes"), F.md5("content").alias("md5"), reason.alias("verdict"))


def read_binaries(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def audit_binaries(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """A9 over a folder; each task reads its own files."""
    return audit_files(read_binaries(spark, path, pattern))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of files; the content column is pruned, so nothing is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def retention_plan(editions: DataFrame, files: DataFrame, as_of: str, months: int = 12) -> DataFrame:
    """A16 - stored PDFs of processed editions without a hit, older than ``months`` x 30 days."""
    floor = F.date_sub(F.lit(as_of).cast("date"), max(30, months) * 30).cast("string")
    e = editions.where((F.col("processed") == 1) & (F.coalesce("has_target", F.lit(0)) == 0) & (F.col("pub_date") < floor) & filled("file_path"))
    return e.join(files.where(F.lower("path").endswith(".pdf")), e["file_path"] == files["path"]).select("edition_id", "pub_date", "path", "bytes")


def retention_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.round(F.coalesce(F.sum("bytes"), F.lit(0)) / (1024 * 1024), 1).alias("mb"))


def expired_backups(files: DataFrame, keep: int) -> DataFrame:
    """A16 - all but the newest ``keep`` files (ties by path). Only the kept ones are ranked, and they are few."""
    kept = files.orderBy(F.desc("modified"), F.desc("path")).limit(max(1, keep)).select("path")
    return files.join(kept, "path", "left_anti")


def storage_usage(files: DataFrame) -> DataFrame:
    """A17 - bytes and files by area (first folder) and extension, with totals."""
    p = F.regexp_replace("path", r"^[a-z]+:/+", "")
    name = F.substring_index(p, "/", -1)
    ext = F.when(name.endswith(".ocr.json"), ".ocr.json").otherwise(F.coalesce(F.nullif(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1), F.lit("")), F.lit("(none)")))
    f = files.select(F.substring_index(p, "/", 1).alias("area"), ext.alias("ext"), "bytes")
    return f.groupBy("area", "ext").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def base_name(path: ColumnLike) -> Column:
    return F.regexp_replace(F.substring_index(text(path), "/", -1), r"(\.ocr)?\.[A-Za-z0-9]+$", "")


def reconcile_files(files: DataFrame, editions: DataFrame, acts: DataFrame) -> DataFrame:
    """A18 - findings: file without row, row without file, text stored but not marked processed, read file without
    enrichment. Files and rows meet by base name; both sides are reduced to one row per name first."""
    f = files.groupBy(base_name("path").alias("base")).agg(F.max(F.lower("path").endswith(".ocr.json")).alias("has_ocr"), F.max(F.lower("path").endswith(".pdf")).alias("has_pdf"))
    enriched = acts.where(filled("summary")).select("edition_id").distinct().withColumn("enriched", F.lit(True))
    e = editions.withColumn("base", F.coalesce(F.nullif(base_name("file_path"), F.lit("")), base_name("text_path"))).where(F.length("base") > 0)
    e = e.join(enriched, "edition_id", "left").select("edition_id", "base", "processed", "text_path", "enriched")
    j = e.join(f, "base", "full_outer")
    has_row, has_file = F.col("edition_id").isNotNull(), F.col("has_ocr").isNotNull()
    finding = F.array_compact(F.array(
        F.when(has_file & ~has_row, "file_without_row"), F.when(has_row & ~has_file, "row_without_file"),
        F.when(filled("text_path") & (F.col("processed") == 0), "text_not_processed"), F.when(F.col("has_ocr") & F.col("enriched").isNull(), "read_not_enriched")))
    return j.select("base", "edition_id", F.explode(finding).alias("finding"))


