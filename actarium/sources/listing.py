"""A4, A5 - candidate editions and document links in listing pages (url, html)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ColumnLike, compute_once, squeeze, text
from ..functions.values import parse_br_date

ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
# selector order of A5: (tag, attribute)
DOCUMENT_TAGS = (("a", "href"), ("iframe", "src"), ("embed", "src"), ("object", "data"))


def unescape(x: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def resolve_url(base: ColumnLike, href: Column) -> Column:
    """Absolute form of a link found on ``base``."""
    b = F.regexp_replace(base if isinstance(base, Column) else F.col(base), "#.*$", "")
    path = F.regexp_replace(b, r"\?.*$", "")
    origin = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.when(path.rlike(r"://[^/]*/"), F.regexp_replace(path, r"[^/]*$", "")).otherwise(F.concat(path, F.lit("/")))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href)).when(href.startswith("?"), F.concat(path, href)).when(href.startswith("#"), F.concat(b, href))
        .otherwise(F.concat(folder, href)))


def extract_links(pages: DataFrame) -> DataFrame:
    """A4 - links that look like editions (a date in the text or the address, or a .pdf). Per listing page the last link
    of an address wins; order is newest first. Input: page_id, url, html."""
    p = compute_once(pages.select("page_id", "url", F.regexp_replace(text("html"), HIDDEN, "").alias("html")), html=F.regexp_replace(text("html"), HIDDEN, ""))
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2)).alias("label"))
    rows = p.select("page_id", "url", F.posexplode(pairs).alias("pos", "a"))
    rows = rows.select("page_id", "url", "pos", F.trim(unescape(F.col("a.href"))).alias("href"), squeeze(unescape(F.regexp_replace("a.label", "<[^>]*>", " "))).alias("label"))
    rows = rows.where((F.length("href") > 0) & ~F.col("href").rlike("^(mailto:|tel:|javascript:)"))
    rows = compute_once(rows, link=resolve_url("url", F.col("href")))
    rows = compute_once(rows, day=F.coalesce(parse_br_date("label"), parse_br_date("link")))
    rows = rows.where(F.col("day").isNotNull() | F.contains(F.lower("link"), F.lit(".pdf")))
    title = F.when(F.length("label") > 0, F.col("label")).otherwise(F.concat(F.lit("Edição "), F.coalesce("day", F.substring_index("link", "/", -1))))
    return rows.groupBy("page_id", "link").agg(F.max_by(F.struct(title.alias("title"), F.col("day").alias("pub_date")), "pos").alias("e")).select(
        "page_id", F.col("link").alias("url"), "e.title", "e.pub_date")


def newest_links(links: DataFrame) -> DataFrame:
    return links.orderBy("page_id", F.desc(F.coalesce("pub_date", F.lit(""))), "url")


def resolve_document_link(pages: DataFrame) -> DataFrame:
    """A5 - first .pdf link per page, by tag order then position. Everything is found in the row of the page."""
    html = F.regexp_replace(text("html"), HIDDEN, "")
    p = compute_once(pages.select("page_id", "url", "html"), html=html)
    found = F.concat(*[
        F.filter(F.transform(F.regexp_extract_all("html", F.lit(rf"(?is)<{tag}\b[^>]*?\b{attr}\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1)), lambda h: F.trim(unescape(h))),
                 lambda h: F.contains(F.lower(h), F.lit(".pdf"))) for tag, attr in DOCUMENT_TAGS])
    p = compute_once(p.select("page_id", "url", F.try_element_at(found, F.lit(1)).alias("href")), href=F.col("href"))
    return p.where(F.col("href").isNotNull()).select("page_id", resolve_url("url", F.col("href")).alias("document_url"))
