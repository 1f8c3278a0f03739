"""I1-I26 - counts, rankings, boards and money totals. Inputs are reduced to their key before they are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..config import QualityConfig
from ..functions.text import filled, first_match, nonblank, text
from ..functions.values import format_money, parse_money
from .quality import one_row, only_mentions
from .search import pending_queue, with_edition
from .windows import at_most

def month_of(c: str = "pub_date") -> Column:
    return F.substring(F.col(c), 1, 7)


def _z(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0).cast("bigint"))


def counts_by_edition(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("edition_id").agg(F.count("*").alias(name))


def basic_stats(editions: DataFrame, acts: DataFrame, mentions: DataFrame) -> DataFrame:
    """I1 - one row of totals with the de-duplicated money sum and the last date with an act."""
    e = editions.agg(F.count("*").alias("editions"), F.count_if(F.col("has_target") == 1).alias("target_editions"), F.count_if(F.col("processed") == 0).alias("pending"))
    a = acts.agg(F.count("*").alias("acts"))
    m = mentions.agg(F.count("*").alias("mentions"))
    s = sum_values(acts).select(format_money("total").alias("money"), "n_unique", "n_valued")
    last = acts.select("edition_id").distinct().join(editions.where(filled("pub_date")).select("edition_id", "pub_date"), "edition_id").agg(F.max("pub_date").alias("last_day"))
    return one_row(e, a, m, s, last).withColumn("last_day", F.coalesce("last_day", F.lit("—")))


def acts_per_month(editions: DataFrame, acts: DataFrame, k: int = 12) -> DataFrame:
    """I2 - last k months; ``target_rows`` counts joined rows (an edition with three acts counts three times)."""
    a = counts_by_edition(acts, "n")
    j = editions.where(F.col("pub_date").isNotNull()).join(a, "edition_id", "left").groupBy(month_of().alias("month")).agg(
        F.sum(_z("n")).alias("total"), F.sum(F.when(F.col("has_target") == 1, F.greatest(_z("n"), F.lit(1))).otherwise(0)).alias("target_rows"))
    return j.orderBy(F.desc("month")).limit(k)


def timeline_per_month(editions: DataFrame, acts: DataFrame, k: int = 18) -> DataFrame:
    """I3 - last k months with distinct editions, target editions, acts and types. Types per edition are reduced first."""
    a = acts.groupBy("edition_id").agg(F.count("*").alias("n"), F.collect_set("act_type").alias("ts"))
    j = editions.where(F.col("pub_date").isNotNull()).join(a, "edition_id", "left").groupBy(month_of().alias("month")).agg(
        F.count("*").alias("editions"), F.count_if(F.col("has_target") == 1).alias("target_editions"), F.sum(_z("n")).alias("acts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("ts", F.array().cast("array<string>")))))).alias("types"))
    return j.orderBy(F.desc("month")).limit(k).withColumn("types", F.array_join("types", ","))


def acts_per_type(acts: DataFrame, k: int = 10) -> DataFrame:
    """I4 - most frequent types."""
    return acts.groupBy(F.coalesce("act_type", F.lit("Sem tipo")).alias("act_type")).agg(F.count("*").alias("total")).orderBy(F.desc("total"), "act_type").limit(k)


def _dated(acts: DataFrame, editions: DataFrame, since: str | None, until: str | None) -> DataFrame:
    e = editions.select("edition_id", "pub_date")
    if since:
        e = e.where(F.col("pub_date") >= since)
    if until:
        e = e.where(F.col("pub_date") <= until)
    return acts.join(e, "edition_id")


def ranking(acts: DataFrame, editions: DataFrame, since: str | None = None, until: str | None = None, k: int = 15) -> DataFrame:
    """I5 - top k types and top k organs, in one pass with grouping sets."""
    j = _dated(acts, editions, since, until).select(
        F.coalesce(F.nullif(F.trim("act_type"), F.lit("")), F.lit("(sem tipo)")).alias("t"), F.coalesce(F.nullif(F.trim("organ"), F.lit("")), F.lit("(sem órgão)")).alias("o"))
    g = j.groupingSets([[F.col("t")], [F.col("o")]], "t", "o").agg(F.count("*").alias("n"), F.grouping("t").alias("g"))
    g = g.select(F.when(F.col("g") == 0, "type").otherwise("organ").alias("kind"), F.when(F.col("g") == 0, F.col("t")).otherwise(F.col("o")).alias("key"), "n")
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "key")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def theme_counts(acts: DataFrame, editions: DataFrame, since: str | None = None, until: str | None = None, k: int = 30) -> DataFrame:
    """I6 - occurrences of the comma-separated themes."""
    j = _dated(acts.where(filled("themes")), editions, since, until)
    t = j.select(F.explode(F.split("themes", ",")).alias("x")).select(F.lower(F.trim("x")).alias("theme")).where("theme != ''")
    return t.groupBy("theme").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "theme").limit(k)


def monthly_summary(editions: DataFrame, acts: DataFrame, mentions: DataFrame, as_of: str, years: int = 2) -> DataFrame:
    """I7 - per month: editions, processed, pending, target, acts, mentions."""
    floor = F.add_months(F.lit(as_of).cast("date"), -12 * years).cast("string")
    e = editions.where(filled("pub_date"))
    per = e.join(counts_by_edition(acts, "a"), "edition_id", "left").join(counts_by_edition(mentions, "m"), "edition_id", "left")
    ok = F.col("pub_date") >= floor
    g = per.groupBy(month_of().alias("month")).agg(
        F.count_if(ok).alias("editions"), F.count_if(ok & (F.col("processed") == 1)).alias("processed"), F.count_if(ok & (F.col("processed") == 0)).alias("pending"),
        F.count_if(ok & (F.col("has_target") == 1)).alias("target"), F.sum(_z("a")).alias("acts"), F.sum(_z("m")).alias("mentions"), F.max(ok).alias("hit"))
    return g.where("hit").drop("hit")


def sparkline(acts: DataFrame, editions: DataFrame, k: int = 12) -> DataFrame:
    """I8 - acts of the last k months ascending, with the maximum."""
    j = counts_by_edition(acts, "n").join(editions.where(filled("pub_date")), "edition_id").groupBy(month_of().alias("month")).agg(F.sum("n").alias("n"))
    top = j.orderBy(F.desc("month")).limit(k)
    return one_row_max(top, "n")


def one_row_max(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn("_o", F.lit(1)).join(df.agg(F.max(c).alias(f"max_{c}")).withColumn("_o", F.lit(1)), "_o").drop("_o")


def value_keys(acts: DataFrame, exclude_news: bool = True) -> DataFrame:
    """I9 - amount and identity of every valued act: (organ, number), else (organ, process number in the excerpt), else
    (organ, type, amount)."""
    a = acts.where(filled("value"))
    if exclude_news:
        a = a.where(~F.contains(F.lower(text("category")), F.lit("materia")))
    a = a.withColumn("amount", parse_money("value")).where(F.col("amount").isNotNull())
    organ, kind, num = (F.lower(F.trim(text(c))) for c in ("organ", "act_type", "number"))
    proc = first_match(text("excerpt"), fixed.PROCESS_NUMBER, 1)
    number = F.coalesce(F.nullif(num, F.lit("")), F.concat(F.lit("proc:"), F.lower(proc)))
    key = F.coalesce(F.concat_ws("|", organ, F.nullif(number, F.lit(""))), F.lit(""))
    return a.select("act_id", "amount", F.when(number.isNotNull(), key).otherwise(F.concat_ws("|", organ, kind, F.format_number("amount", 2))).alias("value_key"))


def sum_values(acts: DataFrame, dedup: bool = True, exclude_news: bool = True) -> DataFrame:
    """I9 - raw and de-duplicated money totals, summed as decimals so that the order of rows does not matter. The maximum per key combines before the shuffle, so a key that holds a
    third of the acts costs one row per task."""
    v = value_keys(acts, exclude_news).withColumn("amount", F.col("amount").cast("decimal(28,2)"))
    per = v.groupBy("value_key").agg(F.max("amount").alias("best"), F.sum("amount").alias("raw"), F.count("*").alias("n"))
    agg = per.agg(F.coalesce(F.sum("best" if dedup else "raw").cast("double"), F.lit(0.0)).alias("total"), F.coalesce(F.sum("raw").cast("double"), F.lit(0.0)).alias("raw_total"),
                  F.coalesce(F.sum("n"), F.lit(0)).alias("n_valued"), (F.count("*") if dedup else F.coalesce(F.sum("n"), F.lit(0))).alias("n_unique"))
    return agg.withColumns({"total": F.round("total", 2), "raw_total": F.round("raw_total", 2)})


def daily_summary(acts: DataFrame, editions: DataFrame, day: str, target: str) -> DataFrame:
    """I10 - text of a day: counts, top types, highlights, money."""
    today = acts.join(editions.where(F.col("pub_date") == day).select("edition_id"), "edition_id", "left_semi")
    n = today.agg(F.count("*").alias("n_acts"))
    ne = editions.agg(F.count_if((F.col("pub_date") == day) & (F.col("has_target") == 1)).alias("n_editions"))
    kinds = today.groupBy(F.coalesce(F.nullif(F.trim("act_type"), F.lit("")), F.lit("Outro")).alias("t")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "t").limit(5)
    kinds = kinds.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("o"), "t"))), lambda s: F.concat(
        s["t"], F.lit(" ("), (-s["o"]).cast("string"), F.lit(")"))), ", ").alias("kinds"))
    head = F.concat_ws(" ", F.coalesce(F.nullif(F.col("act_type"), F.lit("")), F.lit("Ato")), F.nullif(F.col("number"), F.lit("")))
    tail = F.substring(F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.nullif(F.col("subject"), F.lit("")), text("organ")), 1, 80)
    line = F.regexp_replace(F.concat(head, F.when(filled("value"), F.concat(F.lit(" — "), "value")).otherwise(""), F.lit(": "), tail), "^[: ]+|[: ]+$", "")
    top = today.select(line.alias("line"), F.when(filled("value"), 0).otherwise(1).alias("v"), "act_id").orderBy("v", F.desc("act_id")).limit(5)
    top = top.agg(F.transform(F.sort_array(F.collect_list(F.struct("v", (-F.col("act_id")).alias("o"), "line"))), lambda s: F.concat(F.lit("  – "), s["line"])).alias("lines"))
    money = sum_values(acts).select(format_money("total").alias("money"))
    r = one_row(n, ne, kinds, top, money)
    rows = F.array_compact(F.concat(
        F.array(F.lit(f"Resumo do dia {day}"), F.format_string(f"• %d publicação(ões) estruturada(s) em %d edição(ões) com {target}", "n_acts", "n_editions"),
                F.when(F.length("kinds") > 0, F.concat(F.lit("• Tipos: "), "kinds")), F.when(F.length("money") > 0, F.concat(F.lit("• Valores (indicador): "), "money")),
                F.when(F.size("lines") > 0, F.lit("• Destaques:"))),
        F.col("lines"), F.array(F.when(F.col("n_acts") == 0, F.lit("• Nenhum ato novo indexado neste recorte.")))))
    return r.select(F.lit(day).alias("day"), "n_acts", "n_editions", F.array_join(rows, "\n").alias("summary_text"))


def edition_board(editions: DataFrame, acts: DataFrame, mentions: DataFrame, jobs: DataFrame, month: str = "") -> DataFrame:
    """I11 - editions with counts, state of the latest job and the label of their month."""
    e = editions.where(month_of() == month) if month else editions
    last = jobs.where("edition_id is not null").groupBy("edition_id").agg(F.max_by(F.struct("status", "stage"), "job_id").alias("j"))
    m = F.coalesce(F.nullif(month_of(), F.lit("")), F.lit("sem-data"))
    labels = F.create_map(*[x for i, n in enumerate(fixed.MONTH_LABELS) for x in (F.lit(f"{i + 1:02d}"), F.lit(n))])
    label = F.when(m == "sem-data", "Sem data").otherwise(F.concat(F.try_element_at(labels, F.substring(m, 6, 2)), F.lit(" de "), F.substring(m, 1, 4)))
    return (
        e.join(counts_by_edition(acts, "n_acts"), "edition_id", "left").join(counts_by_edition(mentions, "n_mentions"), "edition_id", "left").join(last, "edition_id", "left")
        .select("edition_id", "title", "pub_date", _z("n_acts").alias("n_acts"), _z("n_mentions").alias("n_mentions"), F.col("j.status").alias("last_status"),
                F.col("j.stage").alias("last_stage"), m.alias("month"), label.alias("month_label")))


def job_board(jobs: DataFrame, k: int = 200, first_stage: str = "baixando PDF") -> DataFrame:
    """I12 - the k newest runs, by their first row: a run starts at the download stage, at the first row of an edition, or
    at a row without edition. Worst status and last update per run."""
    j = jobs
    key = F.coalesce(F.col("edition_id").cast("string"), F.concat(F.lit("none-"), F.col("job_id").cast("string")))
    w = Window.partitionBy("_key").orderBy("job_id")
    j = j.withColumn("_key", key).withColumn("_run", F.sum(F.when((F.row_number().over(w) == 1) | (F.col("stage") == first_stage), 1).otherwise(0)).over(w))
    rank = F.when(F.col("status") == "erro", 3).when(F.col("status") == "rodando", 2).when(F.col("status") == "aviso", 1).otherwise(0)
    g = j.groupBy("_key", "_run").agg(F.first("edition_id").alias("edition_id"), F.min("job_id").alias("first_job"), F.count("*").alias("n_jobs"), F.max(rank).alias("r"), F.max("updated_at").alias("updated_at"))
    status = F.when(F.col("r") == 3, "erro").when(F.col("r") == 2, "rodando").when(F.col("r") == 1, "aviso").otherwise("concluido")
    return g.orderBy(F.desc("first_job")).limit(k).select("edition_id", "first_job", "n_jobs", status.alias("status"), "updated_at")


def job_counts(jobs: DataFrame) -> DataFrame:
    """I13 - rows per status in one row."""
    c = {n: F.count_if(F.col("status") == s).alias(n) for n, s in (("running", "rodando"), ("warnings", "aviso"), ("errors", "erro"), ("done", "concluido"))}
    return jobs.agg(*c.values(), F.count("*").alias("total"))


def job_activity(jobs: DataFrame, editions: DataFrame) -> DataFrame:
    """I13 - running (5), recent (8) and failed (5) rows, newest first, with their edition. Limits come before the join."""
    parts = [("running", jobs.where("status = 'rodando'"), 5), ("recent", jobs, 8), ("error", jobs.where("status = 'erro'"), 5)]
    out = None
    for name, d, k in parts:
        d = d.orderBy(F.desc("job_id")).limit(k).select(F.lit(name).alias("list"), "job_id", "edition_id", "stage", "status", "message")
        out = d if out is None else out.unionByName(d)
    return out.join(editions.select("edition_id", F.col("title").alias("edition_title"), "pub_date"), "edition_id", "left")


def latest_actions(log: DataFrame, k: int = 30) -> DataFrame:
    """I13 - the k newest rows of an action log (action_id, at, cycle, action, level, detail), newest first."""
    return log.orderBy(F.desc("action_id")).limit(k)


def live_state(jobs: DataFrame) -> DataFrame:
    """I13 - per edition: its rows, has it a running one, and which stage runs."""
    j = jobs.where("edition_id is not null")
    run = F.col("status") == "rodando"
    return j.groupBy("edition_id").agg(F.count("*").alias("n_jobs"), F.max(run).alias("has_running"), F.max_by("stage", F.when(run, F.col("job_id"))).alias("current_stage"))


def only_mention_editions(editions: DataFrame, acts: DataFrame, mentions: DataFrame, include_reviewed: bool = False, k: int | None = 200) -> DataFrame:
    """I14 - target editions without acts, with mention count and distinct terms."""
    m = mentions.groupBy("edition_id").agg(F.count("*").alias("n_mentions"), F.array_join(F.array_sort(F.collect_set("term")), ",").alias("terms"))
    j = only_mentions(editions, acts, not include_reviewed).join(m, "edition_id", "left").select(
        "edition_id", "title", "pub_date", "review", _z("n_mentions").alias("n_mentions"), "terms").orderBy(F.desc_nulls_last("pub_date"), F.desc("edition_id"))
    return j.limit(k) if k else j


def miss_pending(editions: DataFrame, acts: DataFrame, mentions: DataFrame, k: int | None = None) -> DataFrame:
    """I15 - only-mention editions without a recovery hint."""
    return _pending(editions.where(~filled("miss_hint")), acts, mentions, k)


def audit_pending(editions: DataFrame, acts: DataFrame, mentions: DataFrame, k: int | None = None) -> DataFrame:
    """I15 - only-mention editions without an audit, or with one still open."""
    return _pending(editions.where(~filled("audit") | F.contains(F.col("audit"), F.lit('"classificacao": "pendente"'))), acts, mentions, k)


def _pending(editions: DataFrame, acts: DataFrame, mentions: DataFrame, k: int | None) -> DataFrame:
    e = only_mentions(editions.where("processed = 1"), acts, False).join(counts_by_edition(mentions, "n_mentions"), "edition_id", "left").select(
        "edition_id", "pub_date", _z("n_mentions").alias("n_mentions")).orderBy(F.desc_nulls_last("pub_date"), F.desc("edition_id"))
    return e.limit(k) if k else e


def review_counters(editions: DataFrame, acts: DataFrame) -> DataFrame:
    """I16 - only-mention editions by review state."""
    r = F.col("review")
    return only_mentions(editions, acts, False).agg(
        F.count("*").alias("total"), F.count_if(r.isNull() | r.isin("", "pendente")).alias("pending"), F.count_if(r == "revisada").alias("reviewed"), F.count_if(r == "ignorada").alias("ignored"))


def anomaly_list(acts: DataFrame, editions: DataFrame, k: int | None = None) -> DataFrame:
    """I17 - newest anomalies."""
    return at_most(with_edition(acts.where("anomaly = 1"), editions).orderBy(F.desc("act_id")), k)


def facets(acts: DataFrame, editions: DataFrame) -> DataFrame:
    """I18 - last 24 months with acts and the 12 most frequent types."""
    months = acts.select("edition_id").distinct().join(editions.where(filled("pub_date")), "edition_id").select(month_of().alias("key")).distinct().orderBy(F.desc("key")).limit(24)
    types = acts.where(nonblank("act_type")).groupBy(F.col("act_type").alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(12)
    return months.select(F.lit("month").alias("facet"), "key", F.lit(None).cast("bigint").alias("n")).unionByName(types.select(F.lit("type").alias("facet"), "key", "n"))


def corpus_counters(editions: DataFrame, acts: DataFrame, mentions: DataFrame, jobs: DataFrame) -> DataFrame:
    """I19 - rows per table and set sizes of editions with acts, mentions, enrichment."""
    e = editions.agg(F.count("*").alias("editions"), F.count_if(F.col("processed") == 1).alias("processed"), F.count_if(F.col("has_target") == 1).alias("target"))
    with_sum = acts.where(filled("summary"))
    a = acts.agg(F.count("*").alias("acts"), F.count_if(filled("summary")).alias("enriched_acts"), F.count_distinct("edition_id").alias("editions_with_acts"))
    en = with_sum.agg(F.count_distinct("edition_id").alias("editions_enriched"))
    both = editions.where("processed = 1").select("edition_id").intersect(with_sum.select("edition_id")).agg(F.count("*").alias("processed_and_enriched"))
    m = mentions.agg(F.count("*").alias("mentions"), F.count_distinct("edition_id").alias("editions_with_mentions"))
    return one_row(e, a, en, both, m, jobs.agg(F.count("*").alias("jobs")))


def histograms(acts: DataFrame) -> DataFrame:
    """I20 - acts by type, organ and confidence level."""
    cols = (("type", "act_type"), ("organ", "organ"), ("level", "confidence_level"))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("dim"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(vazio)")).alias("key")) for n, c in cols]))
    return acts.select(pairs.alias("p")).groupBy("p.dim", "p.key").agg(F.count("*").alias("n"))


def backlog_by_month(editions: DataFrame, k: int = 6) -> DataFrame:
    """I21 - last k months: total, pending, target."""
    return editions.where(filled("pub_date")).groupBy(month_of().alias("month")).agg(
        F.count("*").alias("total"), F.count_if(F.col("processed") == 0).alias("pending"), F.count_if(F.col("has_target") == 1).alias("target")).orderBy(F.desc("month")).limit(k)


def last_editions(editions: DataFrame, acts: DataFrame, k: int = 10) -> DataFrame:
    """I21 - newest editions with their act count; the limit comes before the join."""
    e = editions.orderBy(F.desc_nulls_last("pub_date"), F.desc("edition_id")).limit(k)
    return e.join(counts_by_edition(acts, "n_acts"), "edition_id", "left").select("edition_id", "pub_date", "processed", "has_target", _z("n_acts").alias("n_acts"))


def month_report(editions: DataFrame, acts: DataFrame, mentions: DataFrame, month: str = "") -> DataFrame:
    """I22 - mentions, acts and enriched acts per edition, with a total row (edition_id NULL)."""
    e = editions.where(F.col("pub_date").startswith(month)) if month else editions
    a = acts.groupBy("edition_id").agg(F.count("*").alias("a"), F.count_if(filled("summary")).alias("x"))
    j = e.select("edition_id", "processed").join(a, "edition_id", "left").join(counts_by_edition(mentions, "m"), "edition_id", "left")
    return j.rollup("edition_id").agg(
        F.count("*").alias("editions"), F.count_if(F.col("processed") == 1).alias("processed"), F.sum(_z("m")).alias("mentions"), F.sum(_z("a")).alias("acts"), F.sum(_z("x")).alias("enriched"),
        F.count_if(_z("m") > 0).alias("with_mentions"), F.count_if(_z("a") > 0).alias("with_acts"))


def log_errors(lines: DataFrame, k: int = 30) -> DataFrame:
    """I23 - error lines of a log (line_no, line): the last k with the total."""
    hit = lines.where(F.col("line").rlike("(?i)ERROR|CRITICAL|Traceback|Exception"))
    last = hit.orderBy(F.desc("line_no")).limit(k).select("line_no", F.substring("line", 1, 200).alias("line")).withColumn("_o", F.lit(1))
    return last.join(hit.agg(F.count("*").alias("total")).withColumn("_o", F.lit(1)), "_o").drop("_o")


def failed_editions(editions: DataFrame, k: int | None = None) -> DataFrame:
    """I24 - editions by failures."""
    return at_most(editions.where(F.coalesce("failures", F.lit(0)) > 0).orderBy(F.desc("failures"), F.desc("edition_id")), k).select(
        "edition_id", "pub_date", "failures", F.substring(text("failure_msg"), 1, 150).alias("message"))


def job_errors(jobs: DataFrame, k: int = 25) -> DataFrame:
    """I24 - job rows that failed by status or by message."""
    bad = F.lower(F.col("status")).isin("erro", "falha", "failed", "error") | F.lower(text("message")).rlike("error|erro|traceback|exception")
    return jobs.where(bad).orderBy(F.desc("job_id")).limit(k).select("job_id", "edition_id", "status", "stage", F.substring(text("message"), 1, 180).alias("message"))


def automation_status(editions: DataFrame, jobs: DataFrame, as_of: Column, as_of_day: str, next_limit: int = 5, recent_days: int = 120, q: QualityConfig = QualityConfig()) -> DataFrame:
    """I25 - one row: liveness of the worker (last event against ``as_of``), queue sizes, quarantine and problems."""
    j = jobs.agg(F.max("updated_at").alias("last_event"), F.count_if(F.col("status") == "rodando").alias("running"), F.count_if(F.col("status") == "erro").alias("errors"))
    e = editions.agg(F.count_if(F.col("processed") == 0).alias("pending"), F.count_if((F.col("processed") == 0) & (F.coalesce("failures", F.lit(0)) >= q.quarantine_failures)).alias("quarantined"))
    nxt = pending_queue(editions, as_of_day, k=next_limit, recent_days=recent_days, q=q).agg(F.count("*").alias("next_cycle"))
    r = one_row(j, e, nxt)
    age = F.unix_timestamp(as_of) - F.unix_timestamp("last_event")
    r = r.withColumn("alive", F.coalesce(age.between(0, q.heartbeat_seconds), F.lit(False)))
    problems = F.array_compact(F.array(F.when(~F.col("alive"), "bot_offline"), F.when(F.col("running") > 10, "muitos_jobs_rodando")))
    return r.select(F.when(F.col("alive"), "ok").otherwise("degraded").alias("status"), "alive", "running", "errors", "pending", "quarantined", "next_cycle",
                    F.array_join(problems, ",").alias("problems"))


def backlog_eta(editions: DataFrame, minutes_per_edition: float, run_limit: int) -> DataFrame:
    """I26 - pending editions and the minutes this run needs (once to twice the rate)."""
    e = editions.agg(F.count_if(F.col("processed") == 0).alias("pending"))
    n = F.least("pending", F.lit(run_limit).cast("bigint"))
    return e.select("pending", n.alias("this_run"), (n * minutes_per_edition).alias("eta_min"), (n * minutes_per_edition * 2).alias("eta_max"))
