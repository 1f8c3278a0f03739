"""G1-G20 - year repair, confidence, gaps, queues of weak acts, and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..config import DetectionConfig, QualityConfig
from ..functions.text import ColumnLike, any_contains, compute_once, filled, fold, let, nonblank, strip, text
from ..functions.values import (flag_list, is_generic_type, json_object_or_empty, merge_flags, normalize_act_type, number_seq, number_year,
                                reference_year, valid_act_number, year_in)
from .extraction import number_anchored
from .linkage import optional
from .windows import at_most

# ---- year repair ---------------------------------------------------------------------------


def year_candidates(year: Column, ref: Column, max_future: int = 1) -> Column:
    """G1 - array of struct(dist, neg_conf, year): years one misread digit away, inside ref-15 .. ref+max_future."""
    s = F.lpad(year.cast("string"), 4, "0")
    r = F.lpad(ref.cast("string"), 4, "0")
    table = F.create_map(*[x for d, alts in fixed.DIGIT_CONFUSIONS.items() for x in (F.lit(d), F.array(*[F.lit(a) for a in alts]))])

    def swap(i: int, ch: Column) -> Column:
        return F.concat(F.substring(s, 1, i), ch, F.substring(s, i + 2, 4)).cast("int")

    parts = []
    for i in range(4):
        ch, rc = F.substring(s, i + 1, 1), F.substring(r, i + 1, 1)
        parts.append(F.transform(F.coalesce(F.try_element_at(table, ch), F.array().cast("array<string>")), lambda a: swap(i, a)))
        parts.append(F.filter(F.array(F.when(ch != rc, swap(i, rc))), lambda y: y.isNotNull()))
    cands = F.filter(F.array_distinct(F.concat(*parts)), lambda y: y.between(ref - 15, ref + max(0, max_future)))
    scored = F.transform(cands, lambda y: let(F.abs(y - ref), lambda d: F.struct(
        d.alias("dist"), F.when(d == 0, -0.95).when(d <= 1, -0.85).otherwise(-0.55).alias("neg_conf"), y.alias("year"))))
    return F.array_sort(scored)


def correct_number_year(number: ColumnLike, edition_date: ColumnLike, doc_date: ColumnLike, as_of_year: int, *texts: ColumnLike,
                        max_future: int = 1) -> Column:
    """G2 - struct(original, final, corrected, confidence, reason, review) for a number whose year may be misread."""
    original = F.nullif(strip(text(number)), F.lit(""))
    blob = F.array_join(F.filter(F.array(*[text(t) for t in texts]), lambda t: F.length(t) > 0), "\n")

    def result(final: Column, corrected, conf: Column | float, reason: Column | str, review: bool) -> Column:
        return F.struct(
            original.alias("original"), final.alias("final"), (corrected if isinstance(corrected, Column) else F.lit(corrected)).alias("corrected"),
            (conf if isinstance(conf, Column) else F.lit(conf)).cast("double").alias("confidence"),
            (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), F.lit(review).alias("review"))

    def judge(v: Column) -> Column:
        clean, ref, year, seq = v["clean"], v["ref"], v["year"], v["seq"]
        good = F.filter(year_candidates(year, ref, max_future), lambda c: c["dist"] <= 1)

        def repair(g: Column) -> Column:
            best, second = F.get(g, F.lit(0)), F.get(g, F.lit(1))
            unique = (F.size(g) > 0) & (second.isNull() | (best["dist"] < second["dist"]))
            final = F.concat(seq, F.lit("/"), F.lpad(best["year"].cast("string"), 4, "0"))
            ys = year.cast("string")
            return (
                F.when(unique, result(final, final != clean, -best["neg_conf"], F.concat(F.lit("ano_futuro_ocr:"), ys, F.lit("→"), best["year"].cast("string")), False))
                .when(year > ref + 10, result(F.lit(None).cast("string"), True, 0.3, F.concat(F.lit("ano_absurdo_descartado:"), ys), True))
                .otherwise(result(clean, False, 0.3, F.concat(F.lit("ano_futuro_sem_candidato:"), ys), True)))

        return (
            F.when(clean.isNull(), result(original, False, 0.0, "sem_numero_valido", False))
            .when(year.isNull(), result(clean, False, 1.0, "sem_ano_4digitos", False))
            .when(year.between(1990, ref + max(0, max_future)), result(clean, False, 1.0, "ok", False))
            .when((F.length(strip(blob)) > 0) & number_anchored(clean, blob), result(clean, False, 0.4, "ano_futuro_ancorado", True))
            .otherwise(let(good, repair)))

    facts = let(valid_act_number(original), lambda c: F.struct(
        c.alias("clean"), reference_year(edition_date, doc_date, as_of_year).alias("ref"), number_year(c).alias("year"), number_seq(c).alias("seq")))
    return let(facts, judge)


def apply_number_correction(acts: DataFrame, as_of_year: int, q: QualityConfig = QualityConfig()) -> DataFrame:
    """G3 - the corrected number, its flags and the review mark. Needs pub_date of the edition."""
    fix = correct_number_year("number", "pub_date", "doc_date", as_of_year, "excerpt", optional(acts, "corrected_text"), optional(acts, "summary"),
                              max_future=q.max_future_years)
    a = compute_once(acts, fix=fix)
    new = F.array(F.when(F.col("fix.corrected"), F.concat(F.lit("numero_corrigido:"), F.col("fix.reason"))), F.when(F.col("fix.review"), F.col("fix.reason")))
    touched = F.col("fix.corrected") | F.col("fix.review") | ~F.col("fix.reason").isin("ok", "sem_ano_4digitos", "sem_numero_valido")
    flags = F.when(touched, merge_flags("flags", F.array_compact(new))).otherwise(flag_list("flags"))
    return a.withColumns({
        "flag_list": flags, "review": F.col("fix.review"),
        "number": F.when(F.col("fix.final").isNotNull() | F.col("fix.corrected"), F.col("fix.final")).otherwise(F.col("number"))})


# ---- confidence ----------------------------------------------------------------------------


def organ_class(x: ColumnLike, cfg: DetectionConfig) -> Column:
    """target, neighbour, generic or empty."""
    def kind(o: Column) -> Column:
        ours = F.contains(o, F.lit(cfg.key))
        return F.when(ours, "target").when(any_contains(o, cfg.neighbour_keys), "neighbour").otherwise("generic")
    return F.when(~nonblank(x), "empty").otherwise(let(fold(text(x)), kind))


def confidence(acts: DataFrame, cfg: DetectionConfig, as_of_year: int, q: QualityConfig = QualityConfig()) -> DataFrame:
    """G4 - score 0-100 with its parts, level (alta / media / revisar), reasons and override.

    Needs pub_date, flag_list, review besides the act fields."""
    a = compute_once(
        acts, _n=valid_act_number("number"), _org=organ_class("organ", cfg), _ref=reference_year("pub_date", F.lit(None), as_of_year),
        _doc=year_in("doc_date"), _has_doc=text("doc_date").rlike(r"\d{4}"), _val=json_object_or_empty(optional(acts, "validation")),
        _flags=F.array_join("flag_list", " "), _generic=is_generic_type("act_type"))
    n, org, flags = F.col("_n"), F.col("_org"), F.col("_flags")
    review = F.col("review") | any_contains(flags, ("precisa_revisao", "ano_futuro_ancorado", "ano_futuro_sem"))
    year = F.regexp_extract(n, r"/(\d{1,4})", 1).try_cast("int")
    coherent = F.when(n.isNotNull() & F.contains(n, F.lit("/")) & year.isNotNull(), year.between(1990, F.col("_ref") + max(0, q.max_future_years)))
    ok = F.get_json_object("_val", "$.ok")
    v = F.col("_val")
    grave = (ok == "false") | _truthy(F.get_json_object(v, "$.grave"))
    warned = _truthy(F.get_json_object(v, "$.avisos")) | _truthy(F.get_json_object(v, "$.leve")) | (F.length(flags) > 0)
    corrected = F.contains(flags, F.lit("numero_corrigido"))
    excerpt = F.length(text("excerpt"))
    # a date without a plausible year counts as the current year, as in the year reader
    doc = F.when(F.col("_has_doc"), F.coalesce("_doc", F.lit(as_of_year)))
    parts = {
        "numero": F.when(n.isNull(), 0).when(review, 8).when(~F.contains(n, F.lit("/")), 12).when(coherent.isNull(), 12).when(coherent, 20).otherwise(8),
        "orgao": F.when(org == "target", 20).when(org == "generic", 8).otherwise(0),
        "resumo": F.when(nonblank(optional(acts, "summary")), 15).otherwise(0),
        "tipo": F.when(~nonblank("act_type"), 0).when(F.col("_generic"), 5).otherwise(15),
        "data": F.when(doc.isNotNull(), F.when(doc.between(F.col("_ref") - 15, F.col("_ref") + 1), 15).otherwise(0)).when(coherent, 8).otherwise(0),
        "validacao": F.when((org == "neighbour") | F.coalesce(grave, F.lit(False)), 0).when(F.coalesce(warned, F.lit(False)), F.when(corrected | (v != "{}"), 5).otherwise(10)).otherwise(10),
        "trecho": F.when(excerpt >= 80, 5).when(excerpt >= 20, 2).otherwise(0),
    }
    reasons = F.array_compact(F.array(
        F.when(n.isNull(), "numero_ausente").when(review, "numero_precisa_revisao").when(~F.contains(n, F.lit("/")), "numero_sem_ano")
        .when(coherent == F.lit(False), "numero_ano_incoerente"),
        F.when(org == "neighbour", "orgao_vizinho").when(org == "generic", "orgao_generico").when(org == "empty", "orgao_vazio"),
        F.when(~nonblank(optional(acts, "summary")), "sem_resumo"),
        F.when(~nonblank("act_type"), "tipo_vazio").when(F.col("_generic"), "tipo_generico"),
        F.when(doc.isNotNull(), F.when(~doc.between(F.col("_ref") - 15, F.col("_ref") + 1), "data_documento_incoerente")).when(~F.coalesce(coherent, F.lit(False)), "data_documento_ausente"),
        F.when(org == "neighbour", "validacao_vizinho").when(F.coalesce(grave, F.lit(False)), "validacao_grave").when(F.coalesce(warned, F.lit(False)) & corrected, "flags_leve_correcao"),
        F.when(excerpt < 20, "trecho_curto")))
    a = a.withColumns({"_p": F.struct(*[e.cast("int").alias(k) for k, e in parts.items()]), "confidence_reasons": reasons})
    raw = sum((F.col(f"_p.{k}") for k in parts), F.lit(0))
    a = a.withColumn("_raw", F.least(F.lit(100), F.greatest(F.lit(0), raw)))
    fb = F.lower(F.trim(text(optional(acts, "feedback"))))
    critical = (F.coalesce(optional(acts, "anomaly", "int"), F.lit(0)) == 1) & any_contains(
        F.lower(text(optional(acts, "anomaly_reason"))), ("valor", "outlier", "inconsist"))
    override = (
        F.when(fb == "errado", "feedback_errado").when(review, "precisa_revisao_ou_ancora").when(critical, "anomalia_critica")
        .when(fb == "correto", "feedback_correto_boost"))
    a = a.withColumn("confidence_override", override)
    o, s = F.col("confidence_override"), F.col("_raw")
    score = F.when(o == "feedback_errado", F.least(s, F.lit(50))).when(o == "feedback_correto_boost", F.least(F.lit(100), s + 10)).otherwise(s)
    level = F.when(o.isin("feedback_errado", "precisa_revisao_ou_ancora", "anomalia_critica"), "revisar").when(
        score >= q.high_min, "alta").when(score >= q.medium_min, "media").otherwise("revisar")
    drop = ("_n", "_org", "_ref", "_doc", "_has_doc", "_val", "_flags", "_generic", "_raw")
    return a.withColumns({"confidence": score.cast("int"), "confidence_level": level, "confidence_parts": F.col("_p")}).drop(*drop, "_p")


def _truthy(x: Column) -> Column:
    return x.isNotNull() & ~x.isin("", "false", "0", "null", "[]", "{}")


def post_process(acts: DataFrame, editions: DataFrame, cfg: DetectionConfig, as_of_year: int, q: QualityConfig = QualityConfig()) -> DataFrame:
    """G5 - year repair, then confidence, with the date of the act's edition."""
    j = acts.join(editions.select("edition_id", "pub_date"), "edition_id", "left")
    return confidence(apply_number_correction(j, as_of_year, q), cfg, as_of_year, q)


# ---- queues of weak acts -------------------------------------------------------------------


def reenrich_queue(acts: DataFrame, editions: DataFrame, k: int = 20, month: str = "", q: QualityConfig = QualityConfig()) -> DataFrame:
    """G6 - acts worth another enrichment: all of them weighted, heaviest first, older first on ties; the first k."""
    return weighed_queue(acts, editions, month, q).orderBy(F.desc("weight"), F.coalesce("pub_date", F.lit("")), F.desc("act_id")).limit(k)


def weighed_queue(acts: DataFrame, editions: DataFrame, month: str = "", q: QualityConfig = QualityConfig()) -> DataFrame:
    """G6 - all acts worth another enrichment, with their weight."""
    weak = (~nonblank("summary") | ~nonblank("organ") | ~nonblank("act_type") | (F.coalesce("enriched", F.lit(0)) == 0)
            | (F.lower(text("confidence_level")) == "revisar"))
    c = acts.where((F.coalesce("attempts", F.lit(0)) < q.max_attempts) & (F.lower(text("enrich_status")) != "esgotado") & weak)
    j = c.join(editions.select("edition_id", "pub_date"), "edition_id")
    if month:
        j = j.where(F.col("pub_date").startswith(month))
    weight = (
        F.when(~nonblank("summary"), 20).otherwise(0) + F.when(is_generic_type("act_type"), 15).otherwise(0) + F.when(~nonblank("organ"), 12).otherwise(0)
        + F.when(~nonblank("value") & any_contains(fold(text("act_type")), fixed.REQUEUE_VALUE_TYPES), 10).otherwise(0)
        + F.when(F.coalesce("enriched", F.lit(0)) == 0, 8).otherwise(0)
        + F.when((F.lower(text("confidence_level")) == "revisar") & ~filled("summary"), 5).otherwise(0))
    text_ = strip(F.coalesce(F.nullif(F.col("excerpt"), F.lit("")), F.nullif(F.col("subject"), F.lit("")), optional(acts, "corrected_text"), F.lit("")))
    return j.withColumn("excerpt", text_).where(F.length("excerpt") > 0).withColumn("weight", weight)


def weak_acts(acts: DataFrame, editions: DataFrame, k: int = 10) -> DataFrame:
    """G7 - acts without summary or value; contract-like ones first."""
    j = acts.where(~nonblank("summary") | ~nonblank("value")).join(editions.select("edition_id", "pub_date"), "edition_id")
    kind = fold(text("act_type"))
    bonus = sum((F.when(F.contains(kind, F.lit(w)), 10).otherwise(0) for w in fixed.WEAK_BONUS_TYPES), F.lit(0))
    bonus = bonus + F.when(~nonblank("value"), 3).otherwise(0) + F.when(~nonblank("summary"), 2).otherwise(0)
    return j.withColumn("bonus", bonus).orderBy(F.desc("bonus"), F.coalesce("pub_date", F.lit("")), F.desc("act_id")).limit(k)


# ---- gaps ----------------------------------------------------------------------------------


def count_hits(x: ColumnLike, cfg: DetectionConfig) -> Column:
    """G8 - struct(hits, headers): mentions of the target and organ headers in the text (cut headers count)."""
    key, stem = cfg.key, cfg.stem
    heads = "|".join(f"{o} de {stem}" for o in ("prefeitura municipal", "municipio", "camara municipal", "prefeitura"))
    return let(fold(text(x)), lambda t: F.struct(
        F.regexp_count(t, F.lit(key)).alias("hits"), F.regexp_count(t, F.lit(heads)).alias("headers")))


def edition_hits(pages: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """G8 per edition: the counts of its pages are added, so no edition text is put together."""
    h = pages.select("edition_id", count_hits("text", cfg).alias("h"))
    return h.groupBy("edition_id").agg(F.sum("h.hits").alias("hits"), F.sum("h.headers").alias("headers"))


def gap_columns(df: DataFrame, mode: str = "reprocess", q: QualityConfig = QualityConfig()) -> DataFrame:
    """G9 - severity, action and score from hits, headers, n_acts, weak_pages, pages, cached."""
    h, hd, n = F.col("hits"), F.col("headers"), F.col("n_acts")
    few_heads = (hd >= 2) & (n < F.greatest(F.lit(1), F.floor(hd / 2)))
    if mode == "audit":
        main, extra = (h >= q.gap_min_hits) & (n <= q.gap_max_acts), F.lit(False)
    else:
        main, extra = (h >= q.gap_min_hits) & (n <= F.greatest(F.lit(1), F.floor(h / 4))), (h >= 2) & (n == 0)
    heads_only = few_heads & ~main
    hit = main | few_heads | extra
    ratio = F.when(F.col("pages") > 0, F.col("weak_pages") / F.col("pages")).otherwise(0.0)
    severity = F.when(~hit, "none").when((ratio >= 0.4) & (h >= q.gap_min_hits), "critical").when(heads_only, "low").otherwise("under")
    out = df.withColumn("severity", severity)
    s = F.col("severity")
    action = F.when(s == "none", "none").when((s == "critical") | ~F.col("cached"), "force_ocr").otherwise("redetect_cache")
    score = F.when(s == "none", 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), (h - n * 3) * 8 + hd * 5 + F.when(s == "critical", 25).otherwise(0))))
    return out.withColumns({"action": action, "score": score.cast("int")})


def diagnose_gaps(editions: DataFrame, pages: DataFrame, acts: DataFrame, metrics: DataFrame, cfg: DetectionConfig, mode: str = "reprocess",
                  q: QualityConfig = QualityConfig()) -> DataFrame:
    """G9 - under-detected editions. All inputs are reduced to one row per edition before they are joined."""
    n = acts.groupBy("edition_id").agg(F.count("*").alias("n_acts"))
    j = editions.select("edition_id", "title", "pub_date", F.col("text_path").isNotNull().alias("cached"))
    j = j.join(edition_hits(pages, cfg), "edition_id", "left").join(n, "edition_id", "left").join(
        metrics.select("edition_id", "pages", "weak_pages"), "edition_id", "left")
    z = F.lit(0).cast("bigint")
    return gap_columns(j.withColumns({c: F.coalesce(F.col(c), z) for c in ("hits", "headers", "n_acts", "pages", "weak_pages")}), mode, q)


def persist_gaps(diagnosed: DataFrame) -> DataFrame:
    """G10 - the gap columns of the edition table."""
    return diagnosed.select("edition_id", "title", "pub_date", F.col("severity").alias("gap_severity"), F.col("score").alias("gap_score"), F.col("hits").alias("gap_hits"),
                            F.col("headers").alias("gap_headers"), F.col("action").alias("gap_action"),
                            F.when(F.col("severity") != "none", "pendente").otherwise("ok").alias("gap_status"))


def pending_gaps(gaps: DataFrame, k: int | None = None) -> DataFrame:
    """G10 - open gaps, highest score first."""
    return at_most(gaps.where("gap_status = 'pendente'").orderBy(F.desc(F.coalesce("gap_score", F.lit(0))), F.desc_nulls_last("pub_date"), F.desc("edition_id")), k)


def under_detected(editions: DataFrame, hits: DataFrame, acts: DataFrame, since: str, k: int | None = None) -> DataFrame:
    """G11 - processed editions since a day with too few acts for their hits or headers, with the audit label."""
    n = acts.groupBy("edition_id").agg(F.count("*").alias("n_acts"))
    e = editions.where((F.col("processed") == 1) & (F.col("pub_date") >= since)).select("edition_id", "pub_date", "text_path")
    j = e.join(hits, "edition_id", "left").join(n, "edition_id", "left").na.fill(0, ["hits", "headers", "n_acts"])
    h, hd, a = F.col("hits"), F.col("headers"), F.col("n_acts")
    rule = F.when((h >= 3) & (a <= F.greatest(F.lit(1), F.floor(h / 4))), "hits").when((hd >= 2) & (a < F.greatest(F.lit(1), F.floor(hd / 2))), "headers").when(
        (h >= 2) & (a == 0), "no_acts")
    label = F.when((h >= 3) & (a <= 1), "UNDER").when((hd >= 2) & (a < F.greatest(F.lit(1), F.floor(hd / 2))), "LOW").otherwise("")
    out = j.withColumns({"rule": rule, "label": label}).where(F.col("rule").isNotNull()).drop("text_path")
    return out.orderBy(F.desc("pub_date"), F.desc("edition_id")).limit(k) if k else out


# ---- summaries -----------------------------------------------------------------------------


def only_mentions(editions: DataFrame, acts: DataFrame, open_only: bool = True) -> DataFrame:
    """Target editions without any act."""
    e = editions.where("has_target = 1")
    if open_only:
        e = e.where(F.col("review").isNull() | F.col("review").isin("", "pendente"))
    return e.join(acts.select("edition_id").distinct(), "edition_id", "left_anti")


def operational_summary(acts: DataFrame, editions: DataFrame, q: QualityConfig = QualityConfig()) -> DataFrame:
    """G12 - ten counters in one row. Each part is a one-row aggregate over all its rows."""
    lv = F.lower(text("confidence_level"))
    a = acts.agg(F.count_if(lv == "revisar").alias("level_review"), F.count_if(lv == "alta").alias("level_high"), F.count_if(lv == "media").alias("level_medium"),
                 F.count_if(F.col("anomaly") == 1).alias("anomalies"), F.count_if(F.contains(text("flags"), F.lit("numero_corrigido"))).alias("year_fixes"))
    e = editions.agg(F.count_if(F.col("gap_status") == "pendente").alias("gaps_open"), F.count_if(F.col("gap_severity") == "under").alias("gaps_under"),
                     F.count_if(F.col("gap_severity") == "critical").alias("gaps_critical"))
    m = only_mentions(editions, acts).agg(F.count("*").alias("only_mention"))
    r = weighed_queue(acts, editions, q=q).agg(F.count("*").alias("requeue"))
    return one_row(a, e, m, r)


def one_row(*parts: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side."""
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def quality_digest(summary: DataFrame, day: str) -> DataFrame:
    """G13 - the daily text block."""
    line = F.format_string(
        "=== DIGEST-QUALIDADE %s ===\nPublicações: alta=%d media=%d revisar=%d\nFila re-IA: %d\nGaps pendentes: %d (under=%d critical=%d)\nFN só-menção: %d\nAnomalias: %d\nCorreções ano OCR (flags): %d\n",
        F.lit(day), "level_high", "level_medium", "level_review", "requeue", "gaps_open", "gaps_under", "gaps_critical", "only_mention", "anomalies", "year_fixes")
    return summary.select(F.lit(day).alias("day"), line.alias("digest"))


def quality_rates(metrics: DataFrame, acts: DataFrame) -> DataFrame:
    """G14 - retention, enrichment and weak-page rates in percent."""
    m = metrics.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("raw_acts", "final_acts", "model_drops", "neighbour_drops", "pages", "weak_pages")],
                    F.count("*").alias("editions"))
    a = acts.agg(F.count("*").alias("acts"), F.count_if(F.col("enriched") == 1).alias("enriched"))

    def pct(x: str, y: str) -> Column:
        return F.when(F.col(y) > 0, F.round(F.col(x) / F.col(y) * 100.0, 1)).otherwise(0.0)

    return one_row(m, a).withColumns({"retention_pct": pct("final_acts", "raw_acts"), "enriched_pct": pct("enriched", "acts"), "weak_page_pct": pct("weak_pages", "pages"),
                                      "not_enriched": F.col("acts") - F.col("enriched")})


COMPLETENESS = ("act_type", "number", "organ", "value", "summary", "subject", "doc_date")


def field_completeness(acts: DataFrame, editions: DataFrame | None = None, month: str = "") -> DataFrame:
    """G15 - per field the number and share of empty values. One aggregate pass, then unpivoted."""
    a = acts
    if month and editions is not None:
        a = acts.join(editions.where(F.col("pub_date").startswith(month)).select("edition_id"), "edition_id", "left_semi")
    agg = a.agg(F.count("*").alias("total"), *[F.count_if(~nonblank(c)).alias(c) for c in COMPLETENESS])
    return agg.unpivot(["total"], list(COMPLETENESS), "field", "missing").withColumn(
        "pct", F.when(F.col("total") > 0, F.round(100.0 * F.col("missing") / F.col("total"), 1)).otherwise(0.0))


def incomplete_acts(acts: DataFrame, editions: DataFrame, month: str = "", k: int | None = None) -> DataFrame:
    """G15 - acts without a number or a summary, newest first (the first k, if given)."""
    j = acts.where(~nonblank("number") | ~nonblank("summary")).join(editions.select("edition_id", "pub_date"), "edition_id")
    j = j.where(F.col("pub_date").startswith(month)) if month else j
    out = j.select("act_id", "pub_date", "act_type", "number", filled("value").alias("has_value"), nonblank("summary").alias("has_summary")).orderBy(F.desc_nulls_last("pub_date"), F.desc("act_id"))
    return out if k is None else out.limit(k)


def neighbour_suspects(acts: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """G16 - acts that name a neighbour and never the target, with the first neighbour of the list."""
    blob = fold(F.array_join(F.array(*[text(c) for c in ("organ", "summary", "subject", "excerpt")]), " "))
    a = compute_once(acts.select("act_id", "edition_id", "organ", blob.alias("_b")), _b=F.col("_b"))
    term = F.coalesce(*[F.when(F.contains(F.col("_b"), F.lit(n)), n) for n in cfg.neighbour_keys])
    return a.withColumn("term", term).where(F.col("term").isNotNull() & ~F.contains(F.col("_b"), F.lit(cfg.key))).drop("_b")


def mention_act_ratio(editions: DataFrame, mentions: DataFrame, acts: DataFrame) -> DataFrame:
    """G17 - acts per mention of the processed target editions, with the suspicion."""
    m = mentions.groupBy("edition_id").agg(F.count("*").alias("n_mentions"))
    a = acts.groupBy("edition_id").agg(F.count("*").alias("n_acts"))
    e = editions.where("processed = 1 AND has_target = 1").select("edition_id", "pub_date").join(m, "edition_id", "left").join(a, "edition_id", "left")
    e = e.na.fill(0, ["n_mentions", "n_acts"])
    men, act = F.col("n_mentions"), F.col("n_acts")
    return e.withColumns({"ratio": F.when(men > 0, F.round(act / men, 2)).otherwise(0.0),
                          "flag": F.when((men >= 5) & (act <= 1), "under_detected").when((men >= 3) & (act == 0), "false_negative").otherwise("")})


def suspicious_values(acts: DataFrame, limit: float = 1e10) -> DataFrame:
    """G18 - absurd, zero or over-long amounts."""
    v = F.trim(text("value"))
    nums = F.transform(F.regexp_extract_all(v, F.lit(r"[\d.,]+"), F.lit(0)), lambda s: F.translate(s, ",.", ".").try_cast("double"))
    bad = F.exists(nums, lambda x: F.coalesce((x > limit) | ((x == 0) & (F.length(v) < 5)), F.lit(False)))
    return acts.where((F.length(v) > 0) & (bad | (F.length(v) > 80))).select("act_id", "value")


def reprocess_candidates(editions: DataFrame, mentions: DataFrame, acts: DataFrame, month: str = "") -> DataFrame:
    """G19 - per edition of the month: counts, whether it needs a new run, and its status."""
    m = mentions.groupBy("edition_id").agg(F.count("*").alias("n_mentions"))
    a = acts.groupBy("edition_id").agg(F.count("*").alias("n_acts"), F.count_if(filled("summary")).alias("n_enriched"))
    e = editions.select("edition_id", "pub_date", "processed")
    if month:
        e = e.where(F.col("pub_date").startswith(month))
    e = e.join(m, "edition_id", "left").join(a, "edition_id", "left").na.fill(0, ["n_mentions", "n_acts", "n_enriched"])
    needs = (F.col("processed") == 0) | ((F.col("n_enriched") == 0) & (F.col("n_acts") > 0)) | ((F.col("n_mentions") == 0) & (F.col("processed") == 1))
    status = F.when(F.col("n_enriched") > 0, "OK").when(F.col("n_mentions") > 0, "Fraca").otherwise("Sem conteúdo")
    return e.withColumns({"needs_run": needs, "status": status})


def renormalize_types(acts: DataFrame) -> DataFrame:
    """G20 - acts whose stored type changes under the canonical table."""
    return compute_once(acts.where(filled("act_type")).select("act_id", "act_type"), new_type=normalize_act_type("act_type")).where(
        F.col("new_type").isNotNull() & (F.col("new_type") != F.col("act_type")))


