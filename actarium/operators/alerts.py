"""J1-J5 - which acts raise an alert, and what it says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import QualityConfig
from ..functions.text import abbreviate, filled, text


def is_alert(q: QualityConfig = QualityConfig()) -> Column:
    """J1 - the notify flag decides; without one the importance must reach the threshold (missing = threshold)."""
    n = F.col("notify")
    return F.when(n.isNotNull(), n == 1).otherwise(F.coalesce("importance", F.lit(q.alert_importance)) >= q.alert_importance)


def acts_to_alert(acts: DataFrame, q: QualityConfig = QualityConfig()) -> DataFrame:
    return acts.where(is_alert(q))


def _act_lines() -> Column:
    title = F.concat_ws(" - ", F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("publicação")), *[F.nullif(F.col(c), F.lit("")) for c in ("organ", "act_type", "number")])

    def line(label: str, c: Column, ok: Column) -> Column:
        return F.when(ok, F.concat(F.lit(f"\n  {label}: "), c)).otherwise("")

    return F.concat(F.lit("— Pág. "), F.col("page").cast("string"), F.lit(": "), title, line("Data", F.col("doc_date"), filled("doc_date")), line("Valor", F.col("value"), filled("value")),
                    line("Assunto", abbreviate("subject", 180), filled("subject")), line("IA", abbreviate("summary", 180), filled("summary")))


def _top_lines(df: DataFrame, order: str, line: Column, k: int, name: str) -> DataFrame:
    """First k lines per edition and the row count. The rank limit is applied before the shuffle; the count is a plain
    aggregate."""
    w = Window.partitionBy("edition_id").orderBy("page", order)
    top = df.select("edition_id", "page", order, line.alias("line")).withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= k)
    lines = top.groupBy("edition_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "line"))), lambda s: s["line"]).alias(name))
    return lines.join(df.groupBy("edition_id").agg(F.count("*").alias(f"n_{name}")), "edition_id")


def alert_messages(editions: DataFrame, acts: DataFrame, mentions: DataFrame, target: str, q: QualityConfig = QualityConfig()) -> DataFrame:
    """J2 - message per edition with a mention or an act: header, at most 5 acts and 10 excerpts with the number of
    further ones, importance and anomaly prefixes, and a mark when all acts are below the threshold."""
    a = acts.withColumn("_alert", is_alert(q))
    state = a.groupBy("edition_id").agg(
        F.max("_alert").alias("any_alert"), F.max(F.when(F.col("_alert"), F.col("importance"))).alias("best"),
        F.max(filled("organ") | filled("act_type") | (F.col("category") == "publicacao_oficial")).alias("official_all"),
        F.max(F.col("_alert") & (filled("organ") | filled("act_type") | (F.col("category") == "publicacao_oficial"))).alias("official_alert"))
    # below the threshold everything is shown (and marked), otherwise only what alerts
    shown = a.join(state.select("edition_id", "any_alert"), "edition_id").where(F.col("_alert") | ~F.col("any_alert"))
    act_part = _top_lines(shown, "act_id", _act_lines(), 5, "acts")
    men_part = _top_lines(mentions, "mention_id", F.concat(F.lit("— Pág. "), F.col("page").cast("string"), F.lit(': "'), abbreviate("excerpt"), F.lit('"')), 10, "excerpts")
    heads = mentions.groupBy("edition_id").agg(F.array_join(F.array_sort(F.collect_set("page")), ", ").alias("pages"), F.array_join(F.array_sort(F.collect_set("term")), ", ").alias("terms"))
    an = a.where("_alert and anomaly = 1")
    anom = _top_lines(an, "act_id", F.trim(text("anomaly_reason")), 3, "reasons")
    j = editions.join(state, "edition_id", "left").join(act_part, "edition_id", "left").join(men_part, "edition_id", "left").join(heads, "edition_id", "left").join(anom, "edition_id", "left")
    j = j.where("n_acts is not null or n_excerpts is not null")
    official = F.coalesce(F.when(F.col("any_alert"), F.col("official_alert")).otherwise(F.col("official_all")), F.lit(False))
    empty = F.array().cast("array<string>")
    more = lambda n, k, what: F.array(F.when(F.col(n) > k, F.format_string(f"— Mais %d {what} omitido(s).", F.col(n) - k)))
    acts_lines = F.when(F.col("n_acts") > 0, F.concat(
        F.array(F.lit("Publicações classificadas:")), F.col("acts"),
        F.array(F.when(F.col("n_acts") > 5, F.format_string("— Mais %d publicação(ões) omitida(s).", F.col("n_acts") - 5))), F.array(F.lit("")))).otherwise(empty)
    body = F.concat(
        F.array(F.when(official, f"Publicação oficial de {target} detectada!").otherwise(f"Menção a {target} detectada (sem publicação oficial identificada)"), F.lit(""),
                F.concat(F.lit("Edição: "), text("title")), F.concat(F.lit("Data: "), F.coalesce(F.nullif(F.col("pub_date"), F.lit("")), F.lit("não informada"))),
                F.concat(F.lit("Páginas: "), text("pages")), F.concat(F.lit("Termos: "), text("terms")), F.lit("")),
        acts_lines, F.array(F.lit("Trechos encontrados:")), F.coalesce("excerpts", empty), more("n_excerpts", 10, "trecho(s)"), F.array(F.lit(""), F.concat(F.lit("Abrir edição: "), F.col("url"))))
    message = F.array_join(F.filter(body, lambda x: x.isNotNull()), "\n")
    suppressed = F.col("n_acts").isNotNull() & ~F.col("any_alert")
    message = F.when(suppressed, F.concat(message, F.lit("\n\n[suprimido: importancia < limiar / notificar=false]"))).otherwise(message)
    message = F.when(~suppressed & (F.coalesce("best", F.lit(0)) > 0), F.concat(F.format_string("Importância %d/5\n\n", "best"), message)).otherwise(message)
    reasons = F.transform(F.filter("reasons", lambda r: F.length(r) > 0), lambda r: F.concat(F.lit("\n• "), r))
    message = F.when(F.col("n_reasons") > 0, F.concat(F.lit("ANOMALIA DETECTADA"), F.array_join(reasons, ""), F.lit("\n\n"), message)).otherwise(message)
    return j.select("edition_id", F.coalesce(suppressed, F.lit(False)).alias("suppressed"), message.alias("message"))


def alert_payload(editions: DataFrame, acts: DataFrame, mentions: DataFrame) -> DataFrame:
    """J3 - JSON payload per edition with acts: counts and at most ten act summaries."""
    item = F.struct(F.col("act_id").alias("id"), F.col("act_type").alias("tipo"), F.col("number").alias("numero"), F.col("importance").alias("importancia"),
                    F.col("confidence").alias("confianca"), F.col("confidence_level").alias("confianca_nivel"))
    w = Window.partitionBy("edition_id").orderBy("act_id")
    top = acts.select("edition_id", "act_id", item.alias("item")).withColumn("_i", F.row_number().over(w)).where("_i <= 10")
    top = top.groupBy("edition_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "item"))), lambda s: s["item"]).alias("items"))
    n = acts.groupBy("edition_id").agg(F.count("*").alias("na"))
    m = mentions.groupBy("edition_id").agg(F.count("*").alias("nm"))
    j = top.join(n, "edition_id").join(m, "edition_id", "left").join(editions.select("edition_id", "title", "url"), "edition_id", "left")
    zero = F.lit(0).cast("bigint")
    body = F.struct(F.col("edition_id").alias("edicao_id"), F.col("title").alias("edicao_titulo"), F.col("na").alias("publicacoes"), F.coalesce("nm", zero).alias("mencoes"), "url",
                    F.col("items").alias("publicacoes_resumo"))
    return j.select("edition_id", F.to_json(body).alias("payload"))


def absence_alert(editions: DataFrame, as_of: str, days: int = 30, target: str = "") -> DataFrame:
    """J4 - one row: is an alert due because no target edition appeared in the window?"""
    floor = F.date_sub(F.lit(as_of).cast("date"), days).cast("string")
    n = editions.agg(F.count_if((F.col("has_target") == 1) & (F.col("pub_date") >= floor)).alias("n_target"))
    msg = f"Alerta de ausência — Nenhuma publicação oficial de {target} foi detectada nos últimos {days} dias."
    return n.select("n_target", (F.col("n_target") == 0).alias("due"), F.when(F.col("n_target") == 0, msg).alias("message"))


def mark_notified(mentions: DataFrame, notified: DataFrame) -> DataFrame:
    """J5 - mentions of the notified editions get the mark."""
    n = notified.select("edition_id").distinct().withColumn("_hit", F.lit(True))
    return mentions.join(n, "edition_id", "left").withColumn("notified", F.when(F.col("_hit"), 1).otherwise(F.col("notified")).cast("int")).drop("_hit")


def notification_log(messages: DataFrame, day: str, channel: str = "arquivo") -> DataFrame:
    """J5 - rows to append to the notification table, partitioned by day."""
    return messages.select("edition_id", F.lit(channel).alias("channel"), F.col("message").alias("content"), F.lit(1).alias("success"), F.lit(day).alias("day"))


def append_notifications(log: DataFrame, path: str) -> None:
    log.write.mode("append").partitionBy("day").parquet(path)


def list_notifications(log: DataFrame, editions: DataFrame, k: int = 100) -> DataFrame:
    """J5 - newest notifications with their edition; the limit comes before the join."""
    top = log.orderBy(F.desc("day"), F.desc_nulls_last("edition_id")).limit(k)
    return top.join(editions.select("edition_id", F.col("title").alias("edition_title"), "pub_date"), "edition_id", "left")
