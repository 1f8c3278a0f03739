"""G-operators: year repair, confidence, gaps and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import quality as G
from . import sqlx as Q
from .projections import AS_OF_YEAR, CONFIG
from .q_detect import anchored_sql
from .q_functions import FLAGS_SQL
from .registry import query

_ALT = " ".join(f"WHEN '{d}' THEN {list(a)!r}" for d, a in fixed.DIGIT_CONFUSIONS.items())


def candidates_sql(y: str, r: str, mx: int = 1) -> str:
    """Sorted list of (dist, neg_conf, year)."""
    s, ref = f"lpad(CAST({y} AS VARCHAR), 4, '0')", f"lpad(CAST({r} AS VARCHAR), 4, '0')"
    parts = []
    for i in range(4):
        pre, post = f"{s}[1:{i}]" if i else "''", f"{s}[{i + 2}:4]"
        parts.append(f"list_transform(CASE {s}[{i + 1}:{i + 1}] {_ALT} ELSE []::VARCHAR[] END, lambda c: CAST({pre} || c || {post} AS INTEGER))")
        parts.append(f"CASE WHEN {s}[{i + 1}:{i + 1}] <> {ref}[{i + 1}:{i + 1}] THEN [CAST({pre} || {ref}[{i + 1}:{i + 1}] || {post} AS INTEGER)] ELSE [] END")
    lst = f"list_filter(list_distinct(flatten([{', '.join(parts)}])), lambda c: c BETWEEN {r} - 15 AND {r} + {mx})"
    return f"list_sort(list_transform({lst}, lambda c: {{'d': abs(c - {r}), 'n': CASE WHEN c = {r} THEN -0.95 WHEN abs(c - {r}) <= 1 THEN -0.85 ELSE -0.55 END, 'y': c}}))"


_YEAR = r"try_cast(regexp_extract(coalesce(number, ''), '/(\d{4})$', 1) AS INTEGER)"


@query("G1_year_candidates", f"""WITH y AS (SELECT act_id, {_YEAR} AS y, CAST(created_day[:4] AS INTEGER) AS r FROM gz_acts)
SELECT act_id, array_to_string(list_transform({candidates_sql('y', 'r')}, lambda c1: c1.y || ':' || c1.d), ',') AS candidates FROM y WHERE y IS NOT NULL""")
def _(t):
    a = t.gz_acts.select("act_id", F.regexp_extract(F.coalesce("number", F.lit("")), r"/(\d{4})$", 1).try_cast("int").alias("y"), F.substring("created_day", 1, 4).cast("int").alias("r"))
    c = G.year_candidates(F.col("y"), F.col("r"))
    return a.where("y is not null").select("act_id", F.array_join(F.transform(c, lambda s: F.concat(s["year"].cast("string"), F.lit(":"), s["dist"].cast("string"))), ",").alias("candidates"))


_BLOB = "concat_ws(chr(10), nullif(excerpt, ''), nullif(summary, ''))"
FIX_CTE = f"""fx0 AS (SELECT a.*, e.pub_date FROM gz_acts a LEFT JOIN gz_editions e USING (edition_id)),
fx1 AS (SELECT *, nullif({Q.strip(Q.txt('number'))}, '') AS orig, {Q.valid_number('number')} AS clean, coalesce({Q.year_in('pub_date')}, {Q.year_in('doc_date')}, {AS_OF_YEAR}) AS ref FROM fx0),
fx2 AS (SELECT *, try_cast(regexp_extract(coalesce(clean, ''), '^(\\d{{1,6}})/(\\d{{4}})$', 2) AS INTEGER) AS yr, regexp_extract(coalesce(clean, ''), '^(\\d{{1,6}})/(\\d{{4}})$', 1) AS sq FROM fx1),
fx3 AS (SELECT *, CASE WHEN yr IS NOT NULL THEN list_filter({candidates_sql('yr', 'ref')}, lambda g: g.d <= 1) END AS good,
  CASE WHEN clean IS NULL THEN 'inv' WHEN yr IS NULL THEN 'noyear' WHEN yr BETWEEN 1990 AND ref + 1 THEN 'ok' WHEN trim({_BLOB}) <> '' AND {anchored_sql('clean', _BLOB)} THEN 'anch' ELSE 'rep' END AS st FROM fx2),
fx4 AS (SELECT *, CASE WHEN st <> 'rep' THEN st WHEN len(good) > 0 AND (len(good) = 1 OR good[1].d < good[2].d) THEN 'fix' WHEN yr > ref + 10 THEN 'absurd' ELSE 'none' END AS k FROM fx3),
fx AS (SELECT *, CASE k WHEN 'inv' THEN orig WHEN 'fix' THEN sq || '/' || lpad(CAST(good[1].y AS VARCHAR), 4, '0') WHEN 'absurd' THEN NULL ELSE clean END AS fin,
  CASE k WHEN 'fix' THEN sq || '/' || lpad(CAST(good[1].y AS VARCHAR), 4, '0') <> clean WHEN 'absurd' THEN true ELSE false END AS corrected,
  CAST(CASE k WHEN 'inv' THEN 0 WHEN 'noyear' THEN 1 WHEN 'ok' THEN 1 WHEN 'anch' THEN 0.4 WHEN 'fix' THEN -good[1].n ELSE 0.3 END AS DOUBLE) AS conf,
  CASE k WHEN 'inv' THEN 'sem_numero_valido' WHEN 'noyear' THEN 'sem_ano_4digitos' WHEN 'ok' THEN 'ok' WHEN 'anch' THEN 'ano_futuro_ancorado' WHEN 'fix' THEN 'ano_futuro_ocr:' || yr || '→' || good[1].y
    WHEN 'absurd' THEN 'ano_absurdo_descartado:' || yr ELSE 'ano_futuro_sem_candidato:' || yr END AS reason, k IN ('anch', 'absurd', 'none') AS review FROM fx4)"""


def _dated(t):
    return t.spread("gz_acts").join(t.gz_editions.select("edition_id", "pub_date"), "edition_id", "left")


@query("G2_correct_number_year", f"WITH {FIX_CTE} SELECT act_id, fin AS final, corrected, conf AS confidence, reason, review FROM fx")
def _(t):
    fix = G.correct_number_year("number", "pub_date", "doc_date", AS_OF_YEAR, "excerpt", "summary")
    return _dated(t).select("act_id", fix.alias("f")).select("act_id", "f.final", "f.corrected", "f.confidence", "f.reason", "f.review")


FLAG_CTE = f"""{FIX_CTE}, fg0 AS (SELECT *, {FLAGS_SQL} AS fl0, list_filter([CASE WHEN corrected THEN 'numero_corrigido:' || reason END, CASE WHEN review THEN reason END], lambda f: f IS NOT NULL) AS nf FROM fx),
fg AS (SELECT * REPLACE (CASE WHEN fin IS NOT NULL OR corrected THEN fin ELSE number END AS number), list_concat(fl0, list_filter(nf, lambda f: NOT list_contains(fl0, f))) AS fl FROM fg0)"""


@query("G3_apply_number_correction", f"WITH {FLAG_CTE} SELECT act_id, number, array_to_string(fl, '|') AS flags, review FROM fg")
def _(t):
    return G.apply_number_correction(_dated(t), AS_OF_YEAR).select("act_id", "number", F.array_join("flag_list", "|").alias("flags"), "review")


_FO = Q.fold(Q.txt("organ"))
CONF_CTE = f"""{FLAG_CTE}, cf0 AS (SELECT *, {Q.valid_number('number')} AS n, array_to_string(fl, ' ') AS ft, coalesce({Q.year_in('pub_date')}, {AS_OF_YEAR}) AS rf, {Q.year_in('doc_date')} AS dy, regexp_matches(coalesce(doc_date, ''), '\\d{{4}}') AS hd,
  CASE WHEN trim(coalesce(organ, '')) = '' THEN 'empty' WHEN contains({_FO}, 'nation_5') THEN 'target' WHEN {Q.any_of(_FO, Q.NEIGHBOURS)} THEN 'neighbour' ELSE 'generic' END AS oc,
  CASE WHEN starts_with(coalesce(validation, ''), '{{') AND json_valid(validation) THEN validation ELSE '{{}}' END AS vj, {Q.generic_type('act_type')} AS gen FROM fg),
cf1 AS (SELECT *, review OR {Q.any_of('ft', ('precisa_revisao', 'ano_futuro_ancorado', 'ano_futuro_sem'))} AS rv, CASE WHEN contains(n, '/') THEN try_cast(regexp_extract(n, '/(\\d{{1,4}})', 1) AS INTEGER) BETWEEN 1990 AND rf + 1 END AS coh,
  CASE WHEN hd THEN coalesce(dy, {AS_OF_YEAR}) END AS doc, coalesce(vj ->> '$.ok', '') = 'false' AS grave, coalesce(vj ->> '$.avisos', '') NOT IN ('', '[]') OR ft <> '' AS warned, contains(ft, 'numero_corrigido') AS cor FROM cf0),
cf2 AS (SELECT *, CASE WHEN n IS NULL THEN 0 WHEN rv THEN 8 WHEN NOT contains(n, '/') THEN 12 WHEN coh IS NULL THEN 12 WHEN coh THEN 20 ELSE 8 END AS p1, CASE oc WHEN 'target' THEN 20 WHEN 'generic' THEN 8 ELSE 0 END AS p2,
  CASE WHEN trim(coalesce(summary, '')) <> '' THEN 15 ELSE 0 END AS p3, CASE WHEN trim(coalesce(act_type, '')) = '' THEN 0 WHEN gen THEN 5 ELSE 15 END AS p4,
  CASE WHEN doc IS NOT NULL THEN CASE WHEN doc BETWEEN rf - 15 AND rf + 1 THEN 15 ELSE 0 END WHEN coh THEN 8 ELSE 0 END AS p5,
  CASE WHEN oc = 'neighbour' OR grave THEN 0 WHEN warned THEN CASE WHEN cor OR vj <> '{{}}' THEN 5 ELSE 10 END ELSE 10 END AS p6, CASE WHEN length(excerpt) >= 80 THEN 5 WHEN length(excerpt) >= 20 THEN 2 ELSE 0 END AS p7,
  lower(trim(coalesce(feedback, ''))) AS fb, anomaly = 1 AND {Q.any_of("lower(coalesce(anomaly_reason, ''))", ('valor', 'outlier', 'inconsist'))} AS crit FROM cf1),
cf3 AS (SELECT *, least(100, greatest(0, p1 + p2 + p3 + p4 + p5 + p6 + p7)) AS raw, CASE WHEN fb = 'errado' THEN 'feedback_errado' WHEN rv THEN 'precisa_revisao_ou_ancora' WHEN crit THEN 'anomalia_critica' WHEN fb = 'correto' THEN 'feedback_correto_boost' END AS ov FROM cf2),
cf4 AS (SELECT *, CAST(CASE ov WHEN 'feedback_errado' THEN least(raw, 50) WHEN 'feedback_correto_boost' THEN least(100, raw + 10) ELSE raw END AS INTEGER) AS score FROM cf3),
cf AS (SELECT *, CASE WHEN ov IN ('feedback_errado', 'precisa_revisao_ou_ancora', 'anomalia_critica') THEN 'revisar' WHEN score >= 85 THEN 'alta' WHEN score >= 55 THEN 'media' ELSE 'revisar' END AS lvl,
  array_to_string(list_filter([CASE WHEN n IS NULL THEN 'numero_ausente' WHEN rv THEN 'numero_precisa_revisao' WHEN NOT contains(n, '/') THEN 'numero_sem_ano' WHEN coh = false THEN 'numero_ano_incoerente' END,
    CASE oc WHEN 'neighbour' THEN 'orgao_vizinho' WHEN 'generic' THEN 'orgao_generico' WHEN 'empty' THEN 'orgao_vazio' END, CASE WHEN p3 = 0 THEN 'sem_resumo' END, CASE p4 WHEN 0 THEN 'tipo_vazio' WHEN 5 THEN 'tipo_generico' END,
    CASE WHEN doc IS NOT NULL THEN CASE WHEN p5 = 0 THEN 'data_documento_incoerente' END WHEN NOT coalesce(coh, false) THEN 'data_documento_ausente' END,
    CASE WHEN oc = 'neighbour' THEN 'validacao_vizinho' WHEN grave THEN 'validacao_grave' WHEN warned AND cor THEN 'flags_leve_correcao' END, CASE WHEN length(excerpt) < 20 THEN 'trecho_curto' END], lambda r: r IS NOT NULL), '|') AS reasons FROM cf4)"""


@query("G4_confidence", f"WITH {CONF_CTE} SELECT act_id, score AS confidence, lvl AS confidence_level, CAST(p1 AS INTEGER) AS numero, CAST(p2 AS INTEGER) AS orgao, CAST(p5 AS INTEGER) AS data, CAST(p6 AS INTEGER) AS validacao, reasons, ov AS override FROM cf")
def _(t):
    c = G.post_process(t.spread("gz_acts"), t.gz_editions, CONFIG, AS_OF_YEAR)
    return c.select("act_id", "confidence", "confidence_level", "confidence_parts.numero", "confidence_parts.orgao", "confidence_parts.data", "confidence_parts.validacao",
                    F.array_join("confidence_reasons", "|").alias("reasons"), F.col("confidence_override").alias("override"))


@query("G5_post_process", f"WITH {CONF_CTE} SELECT act_id, number, score AS confidence, lvl AS confidence_level, array_to_string(fl, '|') AS flags FROM cf")
def _(t):
    c = G.post_process(t.spread("gz_acts"), t.gz_editions, CONFIG, AS_OF_YEAR)
    return c.select("act_id", "number", "confidence", "confidence_level", F.array_join("flag_list", "|").alias("flags"))


_FT = Q.fold(Q.txt("act_type"))
_REQ = f"""p0 AS (SELECT a.*, e.pub_date FROM gz_acts a JOIN gz_editions e USING (edition_id) WHERE coalesce(attempts, 0) < 3 AND coalesce(enrich_status, '') <> 'esgotado' AND (NOT {Q.nonblank('summary')} OR NOT {Q.nonblank('organ')} OR NOT {Q.nonblank('act_type')}
  OR coalesce(enriched, 0) = 0 OR coalesce(confidence_level, '') = 'revisar')),
p1 AS (SELECT *, CASE WHEN NOT {Q.nonblank('summary')} THEN 20 ELSE 0 END + CASE WHEN {Q.generic_type('act_type')} THEN 15 ELSE 0 END + CASE WHEN NOT {Q.nonblank('organ')} THEN 12 ELSE 0 END
  + CASE WHEN NOT {Q.nonblank('value')} AND {Q.any_of(_FT, fixed.REQUEUE_VALUE_TYPES)} THEN 10 ELSE 0 END + CASE WHEN coalesce(enriched, 0) = 0 THEN 8 ELSE 0 END + CASE WHEN confidence_level = 'revisar' AND coalesce(summary, '') = '' THEN 5 ELSE 0 END AS weight FROM p0)"""


@query("G6_reenrich_queue", f"WITH {_REQ} SELECT act_id, pub_date, CAST(weight AS INTEGER) AS weight FROM p1 ORDER BY weight DESC, coalesce(pub_date, ''), act_id DESC LIMIT 20")
def _(t):
    return G.reenrich_queue(t.gz_acts, t.gz_editions, 20).select("act_id", "pub_date", "weight")


@query("G7_weak_acts", f"""WITH p AS (SELECT a.*, e.pub_date FROM gz_acts a JOIN gz_editions e USING (edition_id) WHERE NOT {Q.nonblank('summary')} OR NOT {Q.nonblank('value')})
SELECT act_id, pub_date, CAST({' + '.join(f"CASE WHEN contains({_FT}, '{w}') THEN 10 ELSE 0 END" for w in fixed.WEAK_BONUS_TYPES)} + CASE WHEN NOT {Q.nonblank('value')} THEN 3 ELSE 0 END + CASE WHEN NOT {Q.nonblank('summary')} THEN 2 ELSE 0 END AS INTEGER) AS bonus FROM p
ORDER BY bonus DESC, coalesce(pub_date, ''), act_id DESC LIMIT 10""")
def _(t):
    return G.weak_acts(t.gz_acts, t.gz_editions, 10).select("act_id", "pub_date", "bonus")


_HP = "prefeitura municipal de nat|municipio de nat|camara municipal de nat|prefeitura de nat"
_HITS = f"hits AS (SELECT edition_id, CAST(sum(len(regexp_extract_all(f, 'nation_5'))) AS BIGINT) AS hits, CAST(sum(len(regexp_extract_all(f, '{_HP}'))) AS BIGINT) AS headers FROM (SELECT edition_id, {Q.fold('text')} AS f FROM gz_pages) GROUP BY 1)"


@query("G8_count_hits", f"WITH {_HITS} SELECT * FROM hits")
def _(t):
    return G.edition_hits(t.gz_pages, CONFIG)


def gap_cte(mode: str) -> str:
    main = "hits >= 3 AND n_acts <= 1" if mode == "audit" else "hits >= 3 AND n_acts <= greatest(1, hits // 4)"
    extra = "false" if mode == "audit" else "hits >= 2 AND n_acts = 0"
    return f"""{_HITS}, gd AS (SELECT e.edition_id, e.title, e.pub_date, e.text_path IS NOT NULL AS cached, coalesce(h.hits, 0) AS hits, coalesce(h.headers, 0) AS headers, coalesce(a.n, 0) AS n_acts, coalesce(m.pages, 0) AS pages, coalesce(m.weak_pages, 0) AS weak_pages
  FROM gz_editions e LEFT JOIN hits h USING (edition_id) LEFT JOIN (SELECT edition_id, count(*) AS n FROM gz_acts GROUP BY 1) a USING (edition_id) LEFT JOIN gz_metrics m USING (edition_id)),
gr AS (SELECT *, {main} AS r1, headers >= 2 AND n_acts < greatest(1, headers // 2) AS r2, {extra} AS r3 FROM gd),
gs AS (SELECT *, CASE WHEN NOT (r1 OR r2 OR r3) THEN 'none' WHEN pages > 0 AND weak_pages / pages >= 0.4 AND hits >= 3 THEN 'critical' WHEN r2 AND NOT r1 THEN 'low' ELSE 'under' END AS severity FROM gr),
gap AS (SELECT *, CASE WHEN severity = 'none' THEN 'none' WHEN severity = 'critical' OR NOT cached THEN 'force_ocr' ELSE 'redetect_cache' END AS action,
  CAST(CASE WHEN severity = 'none' THEN 0 ELSE greatest(0, least(100, (hits - n_acts * 3) * 8 + headers * 5 + CASE WHEN severity = 'critical' THEN 25 ELSE 0 END)) END AS INTEGER) AS score FROM gs)"""


def _gaps(t, mode="reprocess"):
    return G.diagnose_gaps(t.gz_editions, t.gz_pages, t.gz_acts, t.gz_metrics, CONFIG, mode)


@query("G9_diagnose_gaps", f"WITH {gap_cte('reprocess')} SELECT edition_id, hits, headers, n_acts, severity, action, score FROM gap")
def _(t):
    return _gaps(t).select("edition_id", "hits", "headers", "n_acts", "severity", "action", "score")


@query("G9_diagnose_gaps_audit", f"WITH {gap_cte('audit')} SELECT edition_id, hits, headers, n_acts, severity, action, score FROM gap")
def _(t):
    return _gaps(t, "audit").select("edition_id", "hits", "headers", "n_acts", "severity", "action", "score")


@query("G10_pending_gaps", f"WITH {gap_cte('reprocess')} SELECT edition_id, title, pub_date, severity AS gap_severity, score AS gap_score, hits AS gap_hits, headers AS gap_headers, action AS gap_action, 'pendente' AS gap_status FROM gap WHERE severity <> 'none' ORDER BY score DESC, pub_date DESC NULLS LAST, edition_id DESC")
def _(t):
    return G.pending_gaps(G.persist_gaps(_gaps(t)))


@query("G11_under_detected", f"""WITH {_HITS}, j AS (SELECT e.edition_id, e.pub_date, coalesce(h.hits, 0) AS hits, coalesce(h.headers, 0) AS headers, coalesce(a.n, 0) AS n_acts FROM gz_editions e LEFT JOIN hits h USING (edition_id)
  LEFT JOIN (SELECT edition_id, count(*) AS n FROM gz_acts GROUP BY 1) a USING (edition_id) WHERE e.processed = 1 AND e.pub_date >= '1996-01-01'),
r AS (SELECT *, CASE WHEN hits >= 3 AND n_acts <= greatest(1, hits // 4) THEN 'hits' WHEN headers >= 2 AND n_acts < greatest(1, headers // 2) THEN 'headers' WHEN hits >= 2 AND n_acts = 0 THEN 'no_acts' END AS rule,
  CASE WHEN hits >= 3 AND n_acts <= 1 THEN 'UNDER' WHEN headers >= 2 AND n_acts < greatest(1, headers // 2) THEN 'LOW' ELSE '' END AS label FROM j) SELECT * FROM r WHERE rule IS NOT NULL""")
def _(t):
    return G.under_detected(t.gz_editions, G.edition_hits(t.gz_pages, CONFIG), t.gz_acts, "1996-01-01")


_OM = "SELECT count(*) FROM gz_editions e WHERE has_target = 1 AND (review IS NULL OR review IN ('', 'pendente')) AND NOT EXISTS (SELECT 1 FROM gz_acts a WHERE a.edition_id = e.edition_id)"
_OPS = f"""{_REQ}, ops AS (SELECT (SELECT count(*) FROM gz_acts WHERE confidence_level = 'revisar') AS level_review, (SELECT count(*) FROM gz_acts WHERE confidence_level = 'alta') AS level_high,
  (SELECT count(*) FROM gz_acts WHERE confidence_level = 'media') AS level_medium, (SELECT count(*) FROM gz_acts WHERE anomaly = 1) AS anomalies, (SELECT count(*) FROM gz_acts WHERE flags LIKE '%numero_corrigido%') AS year_fixes,
  (SELECT count(*) FROM gz_editions WHERE gap_status = 'pendente') AS gaps_open, (SELECT count(*) FROM gz_editions WHERE gap_severity = 'under') AS gaps_under, (SELECT count(*) FROM gz_editions WHERE gap_severity = 'critical') AS gaps_critical,
  ({_OM}) AS only_mention, (SELECT count(*) FROM p1) AS requeue)"""


@query("G12_operational_summary", f"WITH {_OPS} SELECT * FROM ops")
def _(t):
    return G.operational_summary(t.gz_acts, t.gz_editions)


@query("G13_quality_digest", f"""WITH {_OPS} SELECT '2001-09-01' AS day, format('=== DIGEST-QUALIDADE 2001-09-01 ===' || chr(10) || 'Publicações: alta={{}} media={{}} revisar={{}}' || chr(10) || 'Fila re-IA: {{}}' || chr(10) || 'Gaps pendentes: {{}} (under={{}} critical={{}})' || chr(10)
  || 'FN só-menção: {{}}' || chr(10) || 'Anomalias: {{}}' || chr(10) || 'Correções ano OCR (flags): {{}}' || chr(10), level_high, level_medium, level_review, requeue, gaps_open, gaps_under, gaps_critical, only_mention, anomalies, year_fixes) AS digest FROM ops""")
def _(t):
    return G.quality_digest(G.operational_summary(t.gz_acts, t.gz_editions), "2001-09-01")


_SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("raw_acts", "final_acts", "model_drops", "neighbour_drops", "pages", "weak_pages"))


@query("G14_quality_rates", f"""WITH m AS (SELECT {_SUMS}, count(*) AS editions FROM gz_metrics), a AS (SELECT count(*) AS acts, count(*) FILTER (enriched = 1) AS enriched FROM gz_acts)
SELECT *, CASE WHEN raw_acts > 0 THEN round(final_acts / raw_acts * 100.0, 1) ELSE 0.0 END AS retention_pct, CASE WHEN acts > 0 THEN round(enriched / acts * 100.0, 1) ELSE 0.0 END AS enriched_pct,
  CASE WHEN pages > 0 THEN round(weak_pages / pages * 100.0, 1) ELSE 0.0 END AS weak_page_pct, acts - enriched AS not_enriched FROM m, a""")
def _(t):
    return G.quality_rates(t.gz_metrics, t.gz_acts)


@query("G15_field_completeness", " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS total, count(*) FILTER (trim(coalesce({c}, '')) = '') AS missing, round(100.0 * count(*) FILTER (trim(coalesce({c}, '')) = '') / count(*), 1) AS pct FROM gz_acts" for c in G.COMPLETENESS))
def _(t):
    return G.field_completeness(t.gz_acts)


_NB = Q.fold(" || ' ' || ".join(Q.txt(c) for c in ("organ", "summary", "subject", "excerpt")))


@query("G16_neighbour_suspects", f"""SELECT act_id, edition_id, organ, CASE {' '.join(f"WHEN contains(b, '{n}') THEN '{n}'" for n in Q.NEIGHBOURS)} END AS term FROM (SELECT *, {_NB} AS b FROM gz_acts) WHERE {Q.any_of('b', Q.NEIGHBOURS)} AND NOT contains(b, 'nation_5')""")
def _(t):
    return G.neighbour_suspects(t.gz_acts, CONFIG)


@query("G17_mention_act_ratio", """SELECT e.edition_id, e.pub_date, coalesce(m.n, 0) AS n_mentions, coalesce(a.n, 0) AS n_acts, CASE WHEN coalesce(m.n, 0) > 0 THEN round(coalesce(a.n, 0) / m.n, 2) ELSE 0.0 END AS ratio,
  CASE WHEN coalesce(m.n, 0) >= 5 AND coalesce(a.n, 0) <= 1 THEN 'under_detected' WHEN coalesce(m.n, 0) >= 3 AND coalesce(a.n, 0) = 0 THEN 'false_negative' ELSE '' END AS flag
FROM gz_editions e LEFT JOIN (SELECT edition_id, count(*) AS n FROM gz_mentions GROUP BY 1) m USING (edition_id) LEFT JOIN (SELECT edition_id, count(*) AS n FROM gz_acts GROUP BY 1) a USING (edition_id) WHERE processed = 1 AND has_target = 1""")
def _(t):
    return G.mention_act_ratio(t.gz_editions, t.gz_mentions, t.gz_acts)


@query("G18_suspicious_values", r"""SELECT act_id, value FROM (SELECT act_id, CASE WHEN act_id % 50 = 0 THEN 'R$ 0' WHEN act_id % 77 = 0 THEN '99.999.999.999,00' ELSE value END AS value FROM gz_acts) WHERE trim(coalesce(value, '')) <> '' AND (length(trim(value)) > 80 OR
  len(list_filter(list_transform(regexp_extract_all(value, '[\d.,]+'), lambda s: try_cast(replace(replace(s, '.', ''), ',', '.') AS DOUBLE)), lambda x: x > 1e10 OR (x = 0 AND length(trim(value)) < 5))) > 0)""")
def _(t):
    i = F.col("act_id")
    return G.suspicious_values(t.gz_acts.withColumn("value", F.when(i % 50 == 0, "R$ 0").when(i % 77 == 0, "99.999.999.999,00").otherwise(F.col("value"))))


@query("G19_reprocess_candidates", """SELECT e.edition_id, e.pub_date, e.processed, coalesce(m.n, 0) AS n_mentions, coalesce(a.n, 0) AS n_acts, coalesce(a.x, 0) AS n_enriched,
  processed = 0 OR (coalesce(a.x, 0) = 0 AND coalesce(a.n, 0) > 0) OR (coalesce(m.n, 0) = 0 AND processed = 1) AS needs_run, CASE WHEN coalesce(a.x, 0) > 0 THEN 'OK' WHEN coalesce(m.n, 0) > 0 THEN 'Fraca' ELSE 'Sem conteúdo' END AS status
FROM gz_editions e LEFT JOIN (SELECT edition_id, count(*) AS n FROM gz_mentions GROUP BY 1) m USING (edition_id) LEFT JOIN (SELECT edition_id, count(*) AS n, count(*) FILTER (coalesce(summary, '') <> '') AS x FROM gz_acts GROUP BY 1) a USING (edition_id)""")
def _(t):
    return G.reprocess_candidates(t.gz_editions, t.gz_mentions, t.gz_acts)


@query("G20_renormalize_types", f"SELECT * FROM (SELECT act_id, act_type, {Q.act_type('act_type')} AS new_type FROM gz_acts WHERE coalesce(act_type, '') <> '') WHERE new_type <> act_type")
def _(t):
    return G.renormalize_types(t.gz_acts)


@query("G15_incomplete_acts", f"""SELECT a.act_id, e.pub_date, a.act_type, a.number, coalesce(a.value, '') <> '' AS has_value, {Q.nonblank('a.summary')} AS has_summary FROM gz_acts a JOIN gz_editions e USING (edition_id)
WHERE NOT {Q.nonblank('a.number')} OR NOT {Q.nonblank('a.summary')}""")
def _(t):
    return G.incomplete_acts(t.gz_acts, t.gz_editions)
