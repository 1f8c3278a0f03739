"""A6, A7, A10-A15, A19 - table updates, exports and the mirror tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import act_base_name, filled, slugify, text
from ..functions.values import edition_date_parts
from ..operators.quality import only_mentions
from ..operators.reports import sum_values
from ..operators.windows import numbered


def upsert_editions(existing: DataFrame, incoming: DataFrame, order: str = "seq") -> DataFrame:
    """A6 - insert unknown addresses; known ones take the last non-empty title and the last date. Repeats of an address
    in the input are combined before the join."""
    last = incoming.groupBy("url").agg(
        F.max_by("title", F.when(filled("title"), F.col(order))).alias("n_title"), F.min_by("title", order).alias("first_title"),
        F.max_by("pub_date", F.when(F.col("pub_date").isNotNull(), F.col(order))).alias("n_date"))
    j = existing.select("url", "title", "pub_date", F.lit(True).alias("old")).join(last, "url", "full_outer")
    return j.select("url", F.coalesce("n_title", "title", "first_title").alias("title"), F.coalesce("n_date", "pub_date").alias("pub_date"), F.col("old").isNull().alias("inserted"))


def new_editions(incoming: DataFrame, existing: DataFrame, cap: int, force: bool = False) -> DataFrame:
    """A7 - unseen addresses, newest first, at most ``cap`` per cycle."""
    n = incoming if force else incoming.join(existing.select("url").distinct(), "url", "left_anti")
    return n.orderBy(F.desc(F.coalesce("pub_date", F.lit(""))), "url").limit(cap)


def replace_by_edition(target: DataFrame, new: DataFrame) -> DataFrame:
    """A19 - all acts of the re-detected editions are replaced."""
    return target.join(new.select("edition_id").distinct(), "edition_id", "left_anti").unionByName(new, allowMissingColumns=True)


def write_by_edition(acts: DataFrame, path: str) -> None:
    """A19 on disk - dynamic partition overwrite touches only the editions that are written."""
    # one directory is written by few tasks; a very large edition is split again by the adaptive rebalance
    acts.hint("rebalance", "edition_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("edition_id").parquet(path)


def export_rows(acts: DataFrame, editions: DataFrame) -> DataFrame:
    """A10/A11 - the fixed field list, newest first."""
    j = acts.join(editions.select("edition_id", F.col("title").alias("edition_title"), "pub_date"), "edition_id")
    return j.select(*fixed.EXPORT_FIELDS)


def export_csv(rows: DataFrame, path: str) -> None:
    """A10 - semicolon separated, everything quoted, with header. Files are sorted by date within each partition."""
    rows.write.mode("overwrite").options(sep=";", quoteAll=True, header=True, escape='"', emptyValue="", nullValue="").csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    """A11 - one JSON object per line, NULL fields kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def mirror_rows(acts: DataFrame, editions: DataFrame) -> DataFrame:
    """A12 - one row per act with its number within the day of the edition and its file stem."""
    j = acts.join(editions.select("edition_id", "pub_date", F.col("title").alias("edition_title"), F.col("url").alias("edition_url")), "edition_id")
    d = edition_date_parts("pub_date")
    j = j.withColumns({"year": d["year"], "month": d["month"], "day": d["day"]})
    n = numbered(j, ["year", "month", "day"], "act_id", name="seq")
    return n.withColumn("base", act_base_name("seq", "act_type", "number", "organ"))


def mirror_tree(rows: DataFrame) -> DataFrame:
    """A12 - the three trees as (tree, folder, file, act_id): by date, by type and by organ."""
    day = F.when(F.col("year") == "sem-data", F.lit("sem-data")).otherwise(F.concat_ws("-", "year", "month", "day"))
    by = [("por-data", F.concat_ws("/", "year", "month", "day"), F.col("base")),
          ("por-tipo", F.concat_ws("/", slugify("act_type", "Outros", 40), "year"), F.concat_ws("__", day, "base")),
          ("por-orgao", F.concat_ws("/", slugify("organ", "Orgao-nao-identificado", 50), "year"), F.concat_ws("__", day, "base"))]
    trees = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), f.alias("folder"), n.alias("file")) for t, f, n in by]))
    return rows.select("act_id", "edition_id", trees.alias("t")).select("act_id", "edition_id", "t.tree", "t.folder", "t.file")


def write_mirror(rows: DataFrame, path: str) -> None:
    """A12 on disk - one partition per edition (the date tree is in the columns); rewriting an edition replaces only its
    own partition. The rebalance puts an edition into few files and splits a very large one."""
    mirror_records(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("edition_id").parquet(path)


def mirror_records(rows: DataFrame) -> DataFrame:
    """A12 - the stored rows; records are put together after the exchange, which then carries each field once."""
    dealt = rows.select("base", "year", "month", "day", *[c for c in RECORD.values() if c in rows.columns]).hint("rebalance", "edition_id")
    return dealt.withColumn("record", render_json(dealt)).select("act_id", "seq", "base", "record", "year", "month", "day", "edition_id")


RECORD = {"id": "act_id", "edicao_id": "edition_id", "seq": "seq", "tipo": "act_type", "numero": "number", "orgao": "organ", "data_edicao": "pub_date", "data_documento": "doc_date",
          "valor": "value", "pagina": "page", "assunto": "subject", "resumo": "summary", "categoria": "category", "trecho": "excerpt", "feedback": "feedback",
          "edicao_titulo": "edition_title", "edicao_url": "edition_url"}


def render_json(rows: DataFrame) -> Column:
    """A13 - the record of an act as JSON."""
    return F.to_json(F.struct(*[F.col(c).alias(k) for k, c in RECORD.items() if c in rows.columns]), {"ignoreNullFields": "false"})


def _yaml(x: Column) -> Column:
    s = F.replace(F.replace(text(x), F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit("'"))
    quoted = s.rlike(r"[:#\[\]{}]") | (s != F.trim(s)) | (F.length(s) == 0)
    return F.when(quoted, F.concat(F.lit('"'), s, F.lit('"'))).otherwise(s)


def _or(c: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(default))


def render_markdown() -> Column:
    """A13 - the record of an act as Markdown with front matter."""
    kind = _or("act_type", "Ato")
    number = text("number")
    front = [("id", F.col("act_id").cast("string")), ("edicao_id", F.col("edition_id").cast("string")), ("seq", F.col("seq").cast("string")), ("tipo", _yaml(kind)), ("numero", _yaml(number)),
             ("orgao", _yaml(F.col("organ"))), ("data_edicao", _yaml(F.col("pub_date"))), ("data_documento", _yaml(F.col("doc_date"))), ("valor", _yaml(F.col("value"))),
             ("pagina", _or("page", "")), ("categoria", _yaml(F.col("category"))), ("edicao_titulo", _yaml(F.col("edition_title")))]
    meta = [("Órgão", "organ"), ("Data da edição (jornal)", "pub_date"), ("Data do documento", "doc_date"), ("Página no jornal", "page"), ("Valor", "value")]
    summary = F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.nullif(F.col("subject"), F.lit("")), F.lit("_Sem resumo._"))
    lines = [F.lit("---"), *[F.concat(F.lit(f"{k}: "), v) for k, v in front], F.lit("---"), F.lit(""), F.trim(F.concat(F.lit("# "), kind, F.lit(" "), number)), F.lit(""),
             *[F.concat(F.lit(f"**{k}:** "), _or(c, "—")) for k, c in meta], F.lit(""), F.lit("## Resumo"), F.lit(""), summary, F.lit(""), F.lit("## Trecho"), F.lit(""), F.lit("```text"),
             F.coalesce(F.nullif(F.trim("excerpt"), F.lit("")), F.lit("(vazio)")), F.lit("```"), F.lit("")]
    return F.array_join(F.array(*lines), "\n")


def mirror_index(rows: DataFrame) -> DataFrame:
    """A14 - acts per day, month, year and in total."""
    return rows.rollup("year", "month", "day").agg(F.count("*").alias("acts"), F.grouping_id().cast("int").alias("level"))


def audit_report(acts: DataFrame, editions: DataFrame, mentions: DataFrame, classified: DataFrame) -> DataFrame:
    """A15 - the audit bundle as (section, key, value): money sums, acts per type, only-mention editions with their manual
    class, and editions per class. ``classified``: pub_date, class."""
    s = sum_values(acts)
    money = s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in ("n_valued", "n_unique")])).alias("x")).select(F.lit("money").alias("section"), "x.*")
    types = acts.groupBy(F.coalesce("act_type", F.lit("(sem)")).alias("key")).agg(F.count("*").cast("string").alias("value")).select(F.lit("types").alias("section"), "key", "value")
    m = mentions.groupBy("edition_id").agg(F.count("*").alias("n"))
    om = only_mentions(editions, acts, False).select("edition_id", "pub_date").join(m, "edition_id", "left").join(classified, "pub_date", "left")
    cls = F.coalesce("class", F.lit("nao_classificado"))
    listed = om.select(F.lit("only_mention").alias("section"), F.col("edition_id").cast("string").alias("key"),
                       F.concat_ws("|", F.coalesce("n", F.lit(0)).cast("string"), cls).alias("value"))
    counts = classified.groupBy(F.col("class").alias("key")).agg(F.count("*").cast("string").alias("value")).select(F.lit("classes").alias("section"), "key", "value")
    return money.unionByName(types).unionByName(listed).unionByName(counts)


