"""F1-F17 - merging and validating answers of an external model. The answers are a table: act_id, response (JSON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..config import DetectionConfig, QualityConfig
from ..functions.text import (ColumnLike, any_contains, col, compute_once, digits, filled, first_match, fold, let, nonblank, significant_tokens,
                              strip, text)
from ..functions.values import (money_digit_variants, normalize_act_type, normalize_document_date, normalize_money_text,
                                normalize_organ, normalize_theme, parse_money, repair_json, valid_act_number)
from .extraction import preferred_number, reliable_number
from .linkage import optional
from .windows import at_most, with_previous

RESPONSE = (
    "acao string, motivo string, pertence_a_alvo boolean, tem_mencao_alvo boolean, texto_corrigido string, orgao string, tipo string, "
    "numero string, data_documento string, assunto string, valor string, categoria string, resumo string, importancia int, "
    "importancia_motivo string, notificar boolean, tags array<string>, temas array<string>, partes map<string,string>, "
    "checklist map<string,boolean>, i int, classificacao string, confianca double")


def parse_responses(responses: DataFrame) -> DataFrame:
    """Answers as typed columns; truncated JSON is repaired first (B26). ``ok`` is false when nothing could be read."""
    r = compute_once(responses.select("act_id", "response"), json=repair_json("response"))
    return r.select("act_id", F.col("json").isNotNull().alias("ok"), F.from_json("json", RESPONSE).alias("r")).select("act_id", "ok", "r.*")


def route_triage(parsed: DataFrame) -> DataFrame:
    """F1 - keep, discard or mention only."""
    a = F.trim(F.lower(text("acao")))
    return parsed.withColumn("route", F.when(a.isin(*fixed.TRIAGE_DISCARD), "discard").when(a.isin(*fixed.TRIAGE_MENTION), "mention_only").otherwise("keep"))


def gate_reason(cfg: DetectionConfig, organ: str = "orgao") -> Column:
    """F2 - why an answer drops its act (NULL keeps it)."""
    o = fold(text(organ))
    foreign = filled(organ) & ~F.contains(o, F.lit(cfg.key)) & any_contains(o, (*cfg.neighbour_keys, *fixed.FOREIGN_ORGAN_PHRASES))
    return (
        F.when(F.col("pertence_a_alvo") == F.lit(False), "not_ours").when(F.col("tem_mencao_alvo") == F.lit(False), "no_mention")
        .when(foreign, "foreign_organ"))


def gate_enriched(parsed: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """F2 - answers with their drop reason."""
    return parsed.withColumn("drop_reason", gate_reason(cfg))


def gate_counts(gated: DataFrame) -> DataFrame:
    """F2 - model drops and neighbour drops."""
    r = F.col("drop_reason")
    return gated.agg(F.count(r).alias("model_drops"), F.count_if(r.isin("not_ours", "foreign_organ")).alias("neighbour_drops"))


def _tight(x: ColumnLike) -> Column:
    return F.replace(fold(text(x)), F.lit(" "), F.lit(""))


def value_anchored(value: ColumnLike, excerpt: ColumnLike) -> Column:
    """F4 - the amount is supported by the text, as written or by one of its digit forms."""
    c, d = _tight(strip(text(value))), digits(excerpt)
    by_text = (F.length(c) >= 4) & F.contains(_tight(excerpt), c)
    by_digits = let(d, lambda x: (F.length(x) > 0) & F.exists(money_digit_variants(value), lambda v: F.contains(x, v)))
    return F.when(~nonblank(value), True).when(~filled(excerpt), False).otherwise(by_text | by_digits)


def field_anchored(field: ColumnLike, excerpt: ColumnLike, min_ratio: float = 0.35) -> Column:
    """F5 - a field is supported: money by F4, else as a substring, else by the share of its tokens."""
    c = strip(text(field))
    money = F.contains(fold(c), F.lit("r$")) | c.rlike(r"\d+[.,]\d{2}|\d{1,3}(?:\.\d{3})+")
    tight = _tight(c)
    share = let(significant_tokens(c), lambda t: F.when(F.size(t) == 0, True).otherwise(
        F.size(F.array_intersect(t, significant_tokens(excerpt))) / F.size(t) >= min_ratio))
    return (
        F.when(~nonblank(field), True).when(~filled(excerpt), False).when(money, value_anchored(c, excerpt))
        .when((F.length(tight) >= 4) & F.contains(_tight(excerpt), tight), True).otherwise(share))


CHECKED = (("orgao", "orgao"), ("tipo", "tipo"), ("numero", "numero"), ("valor", "valor"), ("data_documento", "data_documento"))


def validate_fields(joined: DataFrame) -> DataFrame:
    """F6 - blank out answer fields the excerpt does not support; ``rejected`` lists them in order, ``valid`` is true if
    none was rejected. Input: the act's excerpt and the answer columns."""
    t, fixed_text = strip(text("excerpt")), strip(text("texto_corrigido"))
    anchor = F.when((F.length(t) < 80) & (F.length(fixed_text) > 0), F.concat(t, F.lit("\n"), fixed_text)).otherwise(t)
    j = compute_once(joined, anchor=anchor)
    ok = {c: (value_anchored(c, "anchor") if c == "valor" else field_anchored(c, "anchor")) | ~filled(c) for c, _ in CHECKED}
    j = compute_once(j, **{f"ok_{c}": e for c, e in ok.items()}, clean_number=valid_act_number("numero"))
    bad_format = F.col("ok_numero") & filled("numero") & F.col("clean_number").isNull()
    rejected = F.filter(F.array(*[F.when(~F.col(f"ok_{c}"), c) for c, _ in CHECKED], F.when(bad_format, "numero")), lambda x: x.isNotNull())
    out = j.withColumn("rejected", rejected)
    for c, _ in CHECKED:
        out = out.withColumn(c, F.when(F.col(f"ok_{c}"), F.col("clean_number") if c == "numero" else F.col(c)))
    return out.withColumn("valid", F.size("rejected") == 0).drop("anchor", "clean_number", *[f"ok_{c}" for c, _ in CHECKED])


def resolve_number(act_type: ColumnLike, number: ColumnLike, excerpt: ColumnLike, corrected: ColumnLike, summary: ColumnLike, cfg: DetectionConfig) -> Column:
    """F7 - an explicit number in the texts wins; a given number only if anchored. A corrected text that is the excerpt is
    not searched again."""
    other = F.when(~col(corrected).eqNullSafe(col(excerpt)), col(corrected))
    found = F.coalesce(*[preferred_number(x, act_type, cfg) for x in (excerpt, other, summary)])
    return F.coalesce(found, reliable_number(number, excerpt, summary, corrected))


def summary_value(x: ColumnLike) -> Column:
    s = text(x)
    return normalize_money_text(F.coalesce(first_match(s, r"R\$\s*[\d.]+,\d{2}"), first_match(s, r"R\$\s*[\d.,]+")))


def resolve_value(value: ColumnLike, excerpt: ColumnLike, summary: ColumnLike, corrected: ColumnLike) -> Column:
    """F7 - the given value if its digits are in the texts, else the summary's, else the first amount of the excerpt."""
    v = normalize_money_text(value)

    def supported(val: Column) -> Column:
        plain = F.replace(_tight(val), F.lit("r$"), F.lit(""))
        by_text = (F.length(plain) > 0) & (F.contains(_tight(excerpt), plain) | F.contains(_tight(summary), plain))
        d = digits(val)
        blobs = F.array(digits(excerpt), digits(summary), digits(corrected))
        cut = F.when(d.endswith("00") & (F.length(d) > 3), F.substring(d, F.lit(1), F.length(d) - 2))
        by_digits = (F.length(d) >= 3) & F.exists(blobs, lambda b: F.contains(b, d) | F.coalesce(F.contains(b, cut), F.lit(False)))
        return F.when(by_text | by_digits, val)

    return F.coalesce(let(v, supported), summary_value(summary), normalize_money_text(first_match(text(excerpt), r"R\$\s*[\d.]+,\d{2}")))


def sanitize_party(name: ColumnLike, *texts: ColumnLike) -> Column:
    """F8 - repair a misread name when the right form stands in the texts."""
    blob = fold(F.array_join(F.array(*[text(t) for t in texts]), " "))
    out = text(name)
    for wrong, right, pattern, repaired in fixed.PARTY_REPAIRS:
        out = F.when(F.contains(fold(text(name)), F.lit(wrong)) & F.contains(blob, F.lit(right)), F.regexp_replace(out, pattern, repaired)).otherwise(out)
    return F.when(filled(name), out).otherwise(F.lit(None))


def importance(act_type: ColumnLike, subject: ColumnLike, summary: ColumnLike, value: ColumnLike) -> Column:
    """F9 - 1 to 5 by type, subject and amount."""
    n = fold(F.array_join(F.array(*[text(x) for x in (act_type, subject, summary, value)]), " "))

    def score(k: Column) -> Column:
        def at(words: tuple[str, ...], v: int) -> Column:
            return F.when(any_contains(k, words), v)
        return F.greatest(F.lit(2), at(fixed.IMPORTANCE_CONTRACT, 4), at(fixed.IMPORTANCE_FISCAL, 4), at(fixed.IMPORTANCE_STAFF, 3),
                          F.when(filled(value), 3), F.when(filled(value) & (F.length(digits(value)) >= 7), 5))

    return let(n, score)


def checklist(act_type: ColumnLike, number: ColumnLike, date: ColumnLike, value: ColumnLike, organ: ColumnLike, subject: ColumnLike,
              excerpt: ColumnLike, hints: Column | None = None) -> Column:
    """F10 - struct of six marks, the missing ones, the score and whether a value is required. ``hints`` is the answer's
    own checklist (map of marks)."""
    required = any_contains(fold(text(act_type)), fixed.VALUE_REQUIRED)
    basis = F.lower(text(excerpt)).rlike(fixed.LEGAL_BASIS)
    marks = {"numero": filled(number), "data": filled(date), "valor": filled(value) | ~required, "orgao": filled(organ),
             "objeto": filled(subject), "fundamentacao": basis}
    if hints is not None:
        marks = {k: m | F.coalesce(F.try_element_at(hints, F.lit(f"tem_{k}")), F.lit(False)) for k, m in marks.items()}
    n_ok = sum((m.cast("int") for m in marks.values()), F.lit(0))
    missing = F.filter(F.array(*[F.when(~m, k) for k, m in marks.items()]), lambda x: x.isNotNull())
    return F.struct(*[m.alias(f"tem_{k}") for k, m in marks.items()], missing.alias("missing"),
                    F.round(100 * n_ok / 6).cast("int").alias("score"), required.alias("value_required"))


def merge_enrichment(acts: DataFrame, responses: DataFrame, cfg: DetectionConfig, q: QualityConfig = QualityConfig()) -> DataFrame:
    """F3 - validated answers merged into their acts. Dropped acts (F2) leave; acts without a readable answer stay as
    they are. The join is on act_id, so both sides shuffle once."""
    p = parse_responses(responses).where("ok")
    j = acts.join(p, "act_id", "left")
    j = validate_fields(j)
    j = j.where(gate_reason(cfg).isNull())
    hit = F.coalesce("ok", F.lit(False))
    corrected = F.coalesce(F.nullif(F.col("texto_corrigido"), F.lit("")), F.col("excerpt"))
    first = {
        "corrected_text": F.when(hit, corrected), "new_summary": F.when(hit, F.col("resumo")).otherwise(F.col("summary")),
        "new_type": F.when(hit, normalize_act_type(F.coalesce(F.nullif(F.col("tipo"), F.lit("")), F.col("act_type")))).otherwise(F.col("act_type")),
        "new_organ": F.when(hit, F.coalesce(normalize_organ("orgao", cfg), F.col("organ"))).otherwise(F.col("organ")),
        "new_subject": F.when(hit, F.coalesce(F.nullif(F.col("assunto"), F.lit("")), F.col("subject"))).otherwise(F.col("subject")),
        "new_date": F.when(hit, F.coalesce(normalize_document_date("data_documento"), F.nullif(F.col("doc_date"), F.lit("")),
                                          normalize_document_date("resumo"), normalize_document_date("excerpt"))).otherwise(F.col("doc_date")),
    }
    j = compute_once(j, **first)
    summary = F.col("new_summary")
    number = resolve_number("new_type", F.coalesce(F.nullif(F.col("numero"), F.lit("")), F.col("number")), "excerpt", "corrected_text", summary, cfg)
    value = resolve_value(F.coalesce(F.nullif(F.col("valor"), F.lit("")), F.col("value")), "excerpt", summary, "corrected_text")
    # the given importance wins if it is 1-5; the rule looks at the value before it is resolved
    imp = F.when(F.col("importancia").between(1, 5), F.col("importancia")).otherwise(importance(
        "new_type", "new_subject", summary, F.coalesce(F.nullif(F.col("value"), F.lit("")), F.col("valor"))))
    # an empty list falls through to the next source
    given = F.coalesce(F.when(F.size("temas") > 0, F.col("temas")), F.when(F.size("tags") > 0, F.col("tags")))
    themes = F.array_join(F.slice(F.array_distinct(F.filter(F.transform(given, normalize_theme), lambda x: x.isNotNull())), 1, 5), ", ")
    j = compute_once(j, new_number=F.when(hit, number).otherwise(F.col("number")), new_value=F.when(hit, value).otherwise(F.col("value")),
                     new_importance=F.when(hit, imp).otherwise(F.col("importance")), new_themes=F.coalesce(F.nullif(themes, F.lit("")), F.col("themes")),
                     contractor=sanitize_party(F.try_element_at("partes", F.lit("contratada")), "excerpt", "new_summary", "corrected_text"))
    notify = F.when(hit, F.coalesce(F.col("notificar").cast("int"), (F.col("new_importance") >= q.alert_importance).cast("int"))).otherwise(F.col("notify"))
    j = j.withColumnRenamed("checklist", "hints")
    out = {
        "organ": F.col("new_organ"), "act_type": F.col("new_type"), "number": F.col("new_number"), "doc_date": F.col("new_date"),
        "subject": F.col("new_subject"), "value": F.col("new_value"), "summary": F.col("new_summary"), "importance": F.col("new_importance").cast("int"),
        "themes": F.col("new_themes"), "notify": notify}
    keep = [out[c].alias(c) if c in out else F.col(c) for c in acts.columns if c != "corrected_text"]
    return j.select(*keep, "corrected_text", "contractor", F.array_join(F.slice("tags", 1, 3), ", ").alias("tags"),
                    checklist("new_type", _either("new_number", "numero"), _either("new_date", "data_documento"), _either("new_value", "valor"),
                              "new_organ", _either("new_subject", "new_summary"), _either("excerpt", "texto_corrigido"), F.col("hints")).alias("checklist"),
                    "rejected", "valid", hit.alias("answered"))


def _either(a: str, b: str) -> Column:
    return F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))


def value_history(acts: DataFrame, n: int = 80) -> DataFrame:
    """F11 - the last n filled values per type, newest first. The rank limit is applied before the shuffle."""
    v = acts.where(nonblank("act_type") & filled("value"))
    w = Window.partitionBy("act_type").orderBy(F.desc("act_id"))
    top = v.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.withColumn("amount", parse_money("value")).where("amount > 0").select("act_type", "rank", "act_id", "amount")


def median_of(values: Column) -> Column:
    """Middle element, or the mean of the two middle ones."""
    def mid(s: Column) -> Column:
        n = F.size(s)
        half = F.floor(n / 2).cast("int")
        return F.when(n == 0, None).when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2.0)
    return let(F.array_sort(values), mid)


def anomalies(acts: DataFrame, back: int = 80, chunk: int = 1 << 16) -> DataFrame:
    """F12 - unusual values, judged against the ``back`` values of the same type before the act. Returns act_id, anomaly,
    reason, notify for the acts with a value; a dominant type is cut into chunks (see ``windows``)."""
    v = acts.where(filled("value")).withColumn("amount", parse_money("value"))
    v = v.select("act_id", F.trim(text("act_type")).alias("kind"), "amount", optional(acts, "importance", "int").alias("importance"),
                 optional(acts, "notify", "int").alias("notify"), F.coalesce("amount", F.lit(-1.0)).alias("hist"))
    v = with_previous(v, ["kind"], "act_id", "hist", back, "history", chunk)
    hist = F.when(F.length("kind") > 0, F.filter("history", lambda x: x > 0)).otherwise(F.array().cast("array<double>"))
    v = v.withColumn("history", hist).withColumn("median", F.when(F.size("history") >= 5, median_of(F.col("history"))))
    a, m = F.col("amount"), F.col("median")
    reasons = F.array_compact(F.array(
        F.when((a >= 100_000) & any_contains(fold("kind"), fixed.ANOMALY_TYPES), F.concat(F.lit("valor alto R$ "), F.translate(F.format_number(a, 2), ",.", ".,"))),
        F.when((m > 0) & (a >= 3.0 * m), F.concat(F.lit("valor "), F.replace(F.format_number(a / m, 1), F.lit(","), F.lit("")), F.lit("× a mediana do tipo ("),
                                                  F.translate(F.format_number(m, 0), ",", "."), F.lit(")"))),
        F.when((F.coalesce("importance", F.lit(0)) >= 5) & (a >= 50_000), "importância máxima com valor elevado")))
    return v.withColumn("_r", reasons).select(
        "act_id", F.size("_r").cast("boolean").cast("int").alias("anomaly"), F.nullif(F.array_join(F.slice("_r", 1, 3), "; "), F.lit("")).alias("reason"),
        F.when(F.size("_r") > 0, F.when(F.col("notify") == 0, 1).otherwise(F.col("notify"))).otherwise(F.col("notify")).alias("notify"))


def is_fiscal(act_type: ColumnLike, themes: ColumnLike, subject: ColumnLike, summary: ColumnLike, excerpt: ColumnLike) -> Column:
    """F13 - fiscal-report words anywhere in the act."""
    return any_contains(fold(F.array_join(F.array(*[text(x) for x in (act_type, themes, subject, summary, excerpt)]), " ")), fixed.FISCAL_KEYS)


def fiscal_listing(acts: DataFrame, editions: DataFrame, k: int | None = None) -> DataFrame:
    """F13 - newest fiscal acts by type, theme, subject or summary."""
    kind, themes, subj, summ = (fold(text(c)) for c in ("act_type", "themes", "subject", "summary"))
    hit = (any_contains(kind, ("rgf", "rreo", "lrf", "balanc", "demonstrat", "fiscal")) | F.contains(themes, F.lit("fiscal"))
           | F.contains(subj, F.lit("lrf")) | F.contains(summ, F.lit("gestao fiscal")))
    e = editions.select("edition_id", F.col("title").alias("edition_title"), "pub_date")
    return at_most(acts.where(hit).join(e, "edition_id").orderBy(F.desc_nulls_last("pub_date"), F.desc("act_id")), k)


def context_pack(rows: DataFrame, key: str, order: list[Column], line: Column, n: int, sep: str = "\n---\n", numbered_lines: bool = True) -> DataFrame:
    """F14 - numbered context text per key from its first n rows (rank limit before the shuffle, so at most n rows per
    key meet in one task)."""
    top = rows.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_i") <= n)
    body = F.concat(F.lit("["), F.col("_i").cast("string"), F.lit("] "), line) if numbered_lines else line
    items = F.array_sort(F.collect_list(F.struct("_i", body.alias("line"))))
    return top.groupBy(key).agg(F.array_join(F.transform(items, lambda s: s["line"]), sep).alias("context"), F.count("*").alias("n_items"))


def audit_context(mentions: DataFrame) -> DataFrame:
    """F14 - eight mentions per edition for the audit."""
    line = F.concat(F.lit("pág."), F.col("page").cast("string"), F.lit(": "), F.substring(text("excerpt"), 1, 400))
    return context_pack(mentions, "edition_id", [F.col("page"), F.col("mention_id")], line, 8, numbered_lines=False)


def triage_context(mentions: DataFrame) -> DataFrame:
    """F14 - fifteen numbered mentions per edition."""
    line = F.concat(F.lit("pág="), F.col("page").cast("string"), F.lit(" termo="), text("term"), F.lit("\n"), F.substring(text("excerpt"), 1, 350))
    return context_pack(mentions, "edition_id", [F.col("page"), F.col("mention_id")], line, 15)


def timeline_context(acts: DataFrame, key: str = "number") -> DataFrame:
    """F14 - twelve acts per chain in order of time."""
    line = F.array_join(F.array(F.coalesce("pub_date", "doc_date", F.lit("?")), F.concat_ws(" ", "act_type", text("number")), text("organ"), text("value"),
                                F.substring(F.coalesce(F.nullif(F.col("summary"), F.lit("")), text("subject")), 1, 120)), " | ")
    return context_pack(acts, key, [F.asc_nulls_first("pub_date"), F.col("act_id")], line, 12, "\n")


def question_context(ranked: DataFrame, key: str = "query_id") -> DataFrame:
    """F14 - the eight best acts of a question."""
    line = F.concat(F.lit("id="), F.col("act_id").cast("string"), F.lit(" tipo="), text("act_type"), F.lit(" num="), text("number"), F.lit("\nresumo="),
                    F.coalesce(F.nullif(F.col("summary"), F.lit("")), text("subject")), F.lit("\ntrecho="), F.substring(text("excerpt"), 1, 500))
    return context_pack(ranked, key, [F.col("rank")], line, 8, "\n\n")


def align_indexed(items: DataFrame, answers: DataFrame, key: str = "edition_id", n: int | None = None) -> DataFrame:
    """F15 - classifications by item number mapped back to the numbered items; unanswered items are 'outro'.

    n: items that were asked for (all, if not given). items: key, idx, mention_id, page, excerpt; answers: key, i, classificacao, confianca (the last answer of a number wins).
    """
    a = answers.where(F.col("i").isNotNull()).groupBy(key, F.col("i").alias("idx")).agg(
        F.max_by(F.struct("classificacao", "confianca"), "seq").alias("a"))
    asked = items if n is None else items.where(F.col("idx") <= n)
    return asked.join(a, [key, "idx"], "left").select(
        key, "idx", "mention_id", "page", F.substring(text("excerpt"), 1, 200).alias("excerpt"),
        F.lower(F.coalesce(F.nullif(F.col("a.classificacao"), F.lit("")), F.lit("outro"))).alias("class"), F.col("a.confianca").alias("score"))


def clean_pages(suggested: ColumnLike, excerpt_pages: ColumnLike) -> Column:
    """F15 - readable page numbers (at most 8), else the pages of the first five excerpts."""
    s = F.filter(F.transform(suggested, lambda p: p.try_cast("int")), lambda p: p.isNotNull())
    return F.slice(F.when(F.size(s) > 0, s).otherwise(F.slice(excerpt_pages, 1, 5)), 1, 8)


def citations(answers: DataFrame, items: DataFrame, key: str = "act_id") -> DataFrame:
    """F15 - item numbers that an answer cites as the acts they stand for: (key, place, cited_id, edition_id, act_type, number).

    answers: key, cited (array of texts, in order); items: key, idx (from 1), cited_id, edition_id, act_type, number.
    What is no number, and numbers of no item, are left out; an item cited twice stays twice."""
    asked = answers.select(key, F.posexplode("cited").alias("place", "_c")).select(key, "place", F.col("_c").try_cast("int").alias("idx"))
    return asked.where("idx is not null").join(items, [key, "idx"]).select(key, "place", "cited_id", "edition_id", "act_type", "number")


def similar_items(acts: DataFrame, similar: DataFrame) -> DataFrame:
    """F14, F15 - the acts like each act as numbered items, in the order of their rank. similar: query_id, rank, act_id (H8)."""
    s = similar.withColumnRenamed("act_id", "cited_id").withColumnsRenamed({"query_id": "act_id", "rank": "idx"})
    about = acts.select(F.col("act_id").alias("cited_id"), *[c for c in acts.columns if c != "act_id"])
    return s.join(about, "cited_id")


def similar_context(items: DataFrame, key: str = "act_id", n: int = 6) -> DataFrame:
    """F14 - the six most similar acts of an act."""
    line = F.concat(F.lit("id="), F.col("cited_id").cast("string"), F.lit(" "), text("act_type"), F.lit(" "), text("number"), F.lit(" "), text("organ"), F.lit(" valor="),
                    F.coalesce(F.nullif(F.col("value"), F.lit("")), F.lit("—")), F.lit(" data="), F.coalesce("pub_date", "doc_date", F.lit("?")), F.lit("\n"),
                    F.substring(F.coalesce(F.nullif(F.col("summary"), F.lit("")), text("subject")), 1, 180))
    return context_pack(items, key, [F.col("idx")], line, n, "\n")


def pending_enrichment(acts: DataFrame, k: int | None = None) -> DataFrame:
    """F17 - acts without a summary or not processed, by edition and id."""
    return at_most(acts.where((F.col("enriched") == 0) | ~filled("summary")).orderBy("edition_id", "act_id"), k)


def retry_pending(acts: DataFrame, responses: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """F16 - outcome of a retry over all pending acts: updated (a summary arrived), kept, or discarded."""
    pending = acts.where((F.col("enriched") == 0) | ~filled("summary"))
    p = parse_responses(responses).where("ok")
    j = pending.select("act_id", "edition_id", "summary", "excerpt").join(p, "act_id", "left")
    j = validate_fields(j)
    outcome = F.when(gate_reason(cfg).isNotNull(), "discarded").when(filled(F.when(F.coalesce("ok", F.lit(False)), F.col("resumo")).otherwise(F.col("summary"))), "updated").otherwise("kept")
    return j.select("act_id", "edition_id", outcome.alias("outcome"))


