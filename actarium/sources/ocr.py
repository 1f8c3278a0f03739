"""A1-A3 - scanned pages as JSON documents or as paged text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text
from .stream_writer import write_files

BLOCK = "struct<pagina:int,bloco:int,texto:string,bbox:array<int>>"
DOCUMENT = f"edition_id bigint, cache_version int, texto_completo string, avisos array<string>, paginas array<struct<pagina:int,texto:string,metodo:string,blocks:array<{BLOCK}>>>"
READABLE_VERSIONS = (1, 2)
MARKER = r"--- Página (\d+) \(([^)]*)\) ---\n"


def read_ocr_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A1 - documents with a readable version and at least one page. A missing version is 1. ``lines`` reads one document
    per line instead of one per file."""
    d = spark.read.schema(DOCUMENT).option("multiLine", not lines).json(path).withColumn("source", F.input_file_name())
    return d.where(F.coalesce("cache_version", F.lit(1)).isin(*READABLE_VERSIONS) & (F.size("paginas") > 0))


def document_pages(documents: DataFrame) -> DataFrame:
    """A1 - one row per page with defaults."""
    p = documents.select("edition_id", F.explode("paginas").alias("p"))
    return p.select("edition_id", F.coalesce("p.pagina", F.lit(0)).alias("page"), text("p.texto").alias("text"),
                    F.coalesce(F.nullif(F.col("p.metodo"), F.lit("")), F.lit("ocr")).alias("method"), F.col("p.blocks").alias("blocks"))


def document_blocks(documents: DataFrame) -> DataFrame:
    """A1 - one row per block with defaults."""
    b = document_pages(documents).select("edition_id", "page", F.posexplode("blocks").alias("seq", "b"))
    box = [F.get("b.bbox", F.lit(i)).alias(n) for i, n in enumerate("ltrb")]
    return b.select("edition_id", F.coalesce("b.pagina", "page").alias("page"), F.coalesce("b.bloco", F.lit(0)).alias("block"), "seq", text("b.texto").alias("text"), *box)


def _inner(json: Column, field: str) -> Column:
    """The value of the only field of a JSON object, as JSON."""
    return json.substr(F.lit(len(field) + 5), F.length(json) - len(field) - 5)


def document_pieces(pages: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """A2 - the JSON documents (one line per edition) in pieces of a page at most: edition_id, part, page, piece, in this
    order, and what stands between pieces of a part. Every page occurs twice, once in the list of pages and once in the whole text."""
    p = pages
    if blocks is not None:
        b = blocks.groupBy("edition_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct(
            "seq", F.struct(F.col("page").alias("pagina"), F.col("block").alias("bloco"), F.col("text").alias("texto"), F.array("l", "t", "r", "b").alias("bbox")).alias("x")))),
            lambda s: s["x"]).alias("blocks"))
        p = p.join(b, ["edition_id", "page"], "left")
    else:
        p = p.withColumn("blocks", F.array().cast(f"array<{BLOCK}>"))
    page = F.to_json(F.struct(F.col("page").alias("pagina"), F.col("text").alias("texto"), F.col("method").alias("metodo"), "blocks"))
    said = _inner(F.to_json(F.struct(page_text().alias("x"))), "x")
    inside = F.inline(F.array(F.struct(F.lit(1).alias("part"), page.alias("body")), F.struct(F.lit(3).alias("part"), said.substr(F.lit(2), F.length(said) - 2).alias("body"))))
    bodies = p.select("edition_id", F.col("page").cast("bigint").alias("page"), inside)
    bodies = bodies.select("edition_id", "part", "page", F.when(F.col("part") == 1, ",").otherwise("\\n\\n").alias("between"), F.col("body").alias("piece"))
    head = F.concat(F.lit('{"edition_id":'), F.col("edition_id").cast("string"), F.lit(',"cache_version":2,"avisos":[],"paginas":['))
    frame = [F.struct(F.lit(i).alias("part"), F.lit(0).cast("bigint").alias("page"), F.lit("").alias("between"), x.alias("piece")) for i, x in (
        (0, head), (2, F.lit('],"texto_completo":"')), (4, F.lit('"}\n')))]
    return bodies.unionByName(pages.select("edition_id").distinct().select("edition_id", F.inline(F.array(*frame))))


def write_ocr_json(pages: DataFrame, path: str, blocks: DataFrame | None = None) -> int:
    """A2 - one nested document per edition (a JSON line), streamed into the files; no row holds an edition."""
    return write_files(document_pieces(pages, blocks), path, None, ["edition_id", "part", "page"], ".json")


def page_text() -> Column:
    return F.concat(F.lit("--- Página "), F.col("page").cast("string"), F.lit(" ("), text("method"), F.lit(") ---\n"), text("text"))


def write_paged_text(pages: DataFrame, path: str) -> int:
    """A3 - one text file per edition with its page markers, streamed page by page."""
    return write_files(pages.select("edition_id", "page", F.lit("\n\n").alias("between"), page_text().alias("piece")), path, "edition_id", ["page"], ".txt")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A3 - text files as (edition_id, document); the file name is the edition."""
    d = spark.read.text(path, wholetext=True)
    return d.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("edition_id"), F.col("value").alias("document"))


def split_paged_text(documents: DataFrame) -> DataFrame:
    """A3 - pages of texts with page markers. Input: edition_id, document."""
    marked = F.regexp_replace("document", r"(?:\n\n)?" + MARKER, "\u0001$1\u0002$2\u0002")
    parts = F.filter(F.split(marked, "\u0001"), lambda s: F.contains(s, F.lit("\u0002")))
    p = documents.select("edition_id", F.explode_outer(parts).alias("x")).where("x is not null")
    s = F.split("x", "\u0002", 3)
    return p.select("edition_id", F.get(s, F.lit(0)).cast("int").alias("page"), F.get(s, F.lit(1)).alias("method"), F.get(s, F.lit(2)).alias("text"))


def read_paged_text(spark: SparkSession, path: str) -> DataFrame:
    """A3 - pages of text files."""
    return split_paged_text(read_documents(spark, path))
