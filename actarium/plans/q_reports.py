"""I- and J-operators: reports and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import alerts as J
from ..operators import reports as R
from . import sqlx as Q
from .projections import AS_OF_DAY, AS_OF_TS
from .registry import query

KEYS_CTE = f"""vk AS (SELECT act_id, a AS amount, CASE WHEN num IS NOT NULL THEN o || '|' || num ELSE o || '|' || t || '|' || format('{{:,.2f}}', a) END AS value_key FROM (
  SELECT act_id, {Q.parse_money('value')} AS a, lower(trim(coalesce(organ, ''))) AS o, lower(trim(coalesce(act_type, ''))) AS t,
    coalesce(nullif(lower(trim(coalesce(number, ''))), ''), 'proc:' || nullif(lower(regexp_extract(excerpt, {Q.lit(fixed.PROCESS_NUMBER)}, 1)), '')) AS num
  FROM gz_acts WHERE coalesce(value, '') <> '' AND NOT contains(category, 'materia')) WHERE a IS NOT NULL)"""
SUM_CTE = f"""{KEYS_CTE}, sm AS (SELECT round(sum(best), 2) AS total, round(sum(raw), 2) AS raw_total, CAST(sum(n) AS BIGINT) AS n_valued, count(*) AS n_unique FROM (SELECT max(amount) AS best, sum(amount) AS raw, count(*) AS n FROM vk GROUP BY value_key))"""


@query("I1_basic_stats", f"""WITH {SUM_CTE} SELECT (SELECT count(*) FROM gz_editions) AS editions, (SELECT count(*) FROM gz_editions WHERE has_target = 1) AS target_editions, (SELECT count(*) FROM gz_editions WHERE processed = 0) AS pending,
  (SELECT count(*) FROM gz_acts) AS acts, (SELECT count(*) FROM gz_mentions) AS mentions, {Q.money_text('total')} AS money, n_unique, n_valued, (SELECT max(pub_date) FROM gz_acts JOIN gz_editions USING (edition_id)) AS last_day FROM sm""")
def _(t):
    return R.basic_stats(t.gz_editions, t.gz_acts, t.gz_mentions)


@query("I2_acts_per_month", "SELECT substr(e.pub_date, 1, 7) AS month, count(a.act_id) AS total, CAST(sum(CASE WHEN e.has_target = 1 THEN 1 ELSE 0 END) AS BIGINT) AS target_rows FROM gz_editions e LEFT JOIN gz_acts a USING (edition_id) WHERE e.pub_date IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
def _(t):
    return R.acts_per_month(t.gz_editions, t.gz_acts)


@query("I3_timeline_per_month", """SELECT substr(e.pub_date, 1, 7) AS month, count(DISTINCT e.edition_id) AS editions, count(DISTINCT CASE WHEN e.has_target = 1 THEN e.edition_id END) AS target_editions, count(a.act_id) AS acts,
  coalesce(array_to_string(list_sort(list(DISTINCT a.act_type) FILTER (a.act_type IS NOT NULL)), ','), '') AS types FROM gz_editions e LEFT JOIN gz_acts a USING (edition_id) WHERE e.pub_date IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 18""")
def _(t):
    return R.timeline_per_month(t.gz_editions, t.gz_acts)


@query("I4_acts_per_type", "SELECT coalesce(act_type, 'Sem tipo') AS act_type, count(*) AS total FROM gz_acts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return R.acts_per_type(t.gz_acts)


@query("I5_ranking", """WITH j AS (SELECT coalesce(nullif(trim(act_type), ''), '(sem tipo)') AS t, coalesce(nullif(trim(organ), ''), '(sem órgão)') AS o FROM gz_acts JOIN gz_editions USING (edition_id) WHERE pub_date >= '1996-01-01' AND pub_date <= '2000-12-31'),
g AS (SELECT 'type' AS kind, t AS key, count(*) AS n FROM j GROUP BY 2 UNION ALL SELECT 'organ', o, count(*) FROM j GROUP BY 2)
SELECT kind, key, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, key) AS rank FROM g) WHERE rank <= 15""")
def _(t):
    return R.ranking(t.gz_acts, t.gz_editions, "1996-01-01", "2000-12-31")


@query("I6_theme_counts", "SELECT lower(trim(x)) AS theme, count(*) AS n FROM (SELECT unnest(string_split(themes, ',')) AS x FROM gz_acts JOIN gz_editions USING (edition_id) WHERE coalesce(themes, '') <> '') WHERE trim(x) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def _(t):
    return R.theme_counts(t.gz_acts, t.gz_editions)


@query("I7_monthly_summary", """WITH p AS (SELECT substr(pub_date, 1, 7) AS month, edition_id, pub_date, processed, has_target FROM gz_editions WHERE pub_date IS NOT NULL)
SELECT month, count(*) FILTER (pub_date >= '1999-09-01') AS editions, count(*) FILTER (pub_date >= '1999-09-01' AND processed = 1) AS processed, count(*) FILTER (pub_date >= '1999-09-01' AND processed = 0) AS pending, count(*) FILTER (pub_date >= '1999-09-01' AND has_target = 1) AS target,
  CAST(sum((SELECT count(*) FROM gz_acts a WHERE a.edition_id = p.edition_id)) AS BIGINT) AS acts, CAST(sum((SELECT count(*) FROM gz_mentions m WHERE m.edition_id = p.edition_id)) AS BIGINT) AS mentions
FROM p GROUP BY month HAVING max(pub_date) >= '1999-09-01'""")
def _(t):
    return R.monthly_summary(t.gz_editions, t.gz_acts, t.gz_mentions, AS_OF_DAY)


@query("I8_sparkline", "WITH s AS (SELECT substr(pub_date, 1, 7) AS month, count(*) AS n FROM gz_acts JOIN gz_editions USING (edition_id) WHERE pub_date IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 12) SELECT month, n, (SELECT max(n) FROM s) AS max_n FROM s")
def _(t):
    return R.sparkline(t.gz_acts, t.gz_editions)


@query("I9_sum_values", f"WITH {SUM_CTE} SELECT * FROM sm")
def _(t):
    return R.sum_values(t.gz_acts)


@query("I9_value_keys", f"WITH {KEYS_CTE} SELECT * FROM vk")
def _(t):
    return R.value_keys(t.gz_acts)


@query("I10_daily_summary", f"""WITH {SUM_CTE}, td AS (SELECT a.* FROM gz_acts a JOIN gz_editions e USING (edition_id) WHERE e.pub_date = '1998-03-12'),
ks AS (SELECT string_agg(t || ' (' || c || ')', ', ' ORDER BY c DESC, t) AS k FROM (SELECT coalesce(nullif(trim(act_type), ''), 'Outro') AS t, count(*) AS c FROM td GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)),
ds AS (SELECT string_agg('  – ' || l, chr(10) ORDER BY v, act_id DESC) AS d FROM (SELECT act_id, CASE WHEN coalesce(value, '') <> '' THEN 0 ELSE 1 END AS v, regexp_replace(concat_ws(' ', coalesce(nullif(act_type, ''), 'Ato'), nullif(number, '')) || CASE WHEN coalesce(value, '') <> '' THEN ' — ' || value ELSE '' END || ': ' ||
  coalesce(nullif(summary, ''), nullif(subject, ''), organ, '')[:80], '^[: ]+|[: ]+$', '', 'g') AS l FROM td ORDER BY v, act_id DESC LIMIT 5)),
c AS (SELECT (SELECT count(*) FROM td) AS na, (SELECT count(*) FROM gz_editions WHERE pub_date = '1998-03-12' AND has_target = 1) AS ne)
SELECT '1998-03-12' AS day, na AS n_acts, ne AS n_editions, concat_ws(chr(10), 'Resumo do dia 1998-03-12', '• ' || na || ' publicação(ões) estruturada(s) em ' || ne || ' edição(ões) com NATION_5', '• Tipos: ' || nullif(k, ''), '• Valores (indicador): ' || {Q.money_text('total')},
  CASE WHEN d IS NOT NULL THEN '• Destaques:' END, d, CASE WHEN na = 0 THEN '• Nenhum ato novo indexado neste recorte.' END) AS summary_text FROM sm, ks, ds, c""")
def _(t):
    return R.daily_summary(t.gz_acts, t.gz_editions, "1998-03-12", "NATION_5")


_ML = " ".join(f"WHEN '{i + 1:02d}' THEN '{n}'" for i, n in enumerate(fixed.MONTH_LABELS))


@query("I11_edition_board", f"""SELECT e.edition_id, e.title, e.pub_date, (SELECT count(*) FROM gz_acts a WHERE a.edition_id = e.edition_id) AS n_acts, (SELECT count(*) FROM gz_mentions m WHERE m.edition_id = e.edition_id) AS n_mentions, j.status AS last_status, j.stage AS last_stage,
  coalesce(substr(pub_date, 1, 7), 'sem-data') AS month, CASE WHEN pub_date IS NULL THEN 'Sem data' ELSE CASE substr(pub_date, 6, 2) {_ML} END || ' de ' || substr(pub_date, 1, 4) END AS month_label
FROM gz_editions e LEFT JOIN (SELECT edition_id, arg_max(status, job_id) AS status, arg_max(stage, job_id) AS stage FROM gz_jobs WHERE edition_id IS NOT NULL GROUP BY 1) j USING (edition_id)""")
def _(t):
    return R.edition_board(t.gz_editions, t.gz_acts, t.gz_mentions, t.gz_jobs)


@query("I12_job_board", """WITH l AS (SELECT *, coalesce(CAST(edition_id AS VARCHAR), 'none-' || job_id) AS k FROM gz_jobs),
r AS (SELECT *, sum(CASE WHEN p IS NULL OR stage = 'baixando PDF' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY job_id) AS run FROM (SELECT *, lag(job_id) OVER (PARTITION BY k ORDER BY job_id) AS p FROM l))
SELECT any_value(edition_id) AS edition_id, min(job_id) AS first_job, count(*) AS n_jobs, CASE WHEN bool_or(status = 'erro') THEN 'erro' WHEN bool_or(status = 'rodando') THEN 'rodando' WHEN bool_or(status = 'aviso') THEN 'aviso' ELSE 'concluido' END AS status, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS updated_at FROM r GROUP BY k, run ORDER BY first_job DESC LIMIT 200""")
def _(t):
    return R.job_board(t.gz_jobs).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query("I13_job_activity", """WITH p AS ((SELECT 'running' AS list, * FROM gz_jobs WHERE status = 'rodando' ORDER BY job_id DESC LIMIT 5) UNION ALL (SELECT 'recent', * FROM gz_jobs ORDER BY job_id DESC LIMIT 8) UNION ALL (SELECT 'error', * FROM gz_jobs WHERE status = 'erro' ORDER BY job_id DESC LIMIT 5))
SELECT list, job_id, p.edition_id, stage, status, message, e.title AS edition_title, e.pub_date FROM p LEFT JOIN gz_editions e USING (edition_id)""")
def _(t):
    return R.job_activity(t.gz_jobs, t.gz_editions)


@query("I13_job_counts", "SELECT count(*) FILTER (status = 'rodando') AS running, count(*) FILTER (status = 'aviso') AS warnings, count(*) FILTER (status = 'erro') AS errors, count(*) FILTER (status = 'concluido') AS done, count(*) AS total FROM gz_jobs")
def _(t):
    return R.job_counts(t.gz_jobs)


@query("I13_live_state", "SELECT edition_id, count(*) AS n_jobs, bool_or(status = 'rodando') AS has_running, arg_max(stage, job_id) FILTER (status = 'rodando') AS current_stage FROM gz_jobs WHERE edition_id IS NOT NULL GROUP BY 1")
def _(t):
    return R.live_state(t.gz_jobs)


_NOACT = "NOT EXISTS (SELECT 1 FROM gz_acts a WHERE a.edition_id = e.edition_id)"


@query("I14_only_mention_editions", f"""SELECT e.edition_id, e.title, e.pub_date, e.review, coalesce(m.n, 0) AS n_mentions, m.terms FROM gz_editions e LEFT JOIN (SELECT edition_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT term)), ',') AS terms FROM gz_mentions GROUP BY 1) m USING (edition_id)
WHERE has_target = 1 AND {_NOACT} AND (review IS NULL OR review IN ('', 'pendente'))""")
def _(t):
    return R.only_mention_editions(t.gz_editions, t.gz_acts, t.gz_mentions, k=None)


@query("I15_miss_pending", f"SELECT e.edition_id, e.pub_date, (SELECT count(*) FROM gz_mentions m WHERE m.edition_id = e.edition_id) AS n_mentions FROM gz_editions e WHERE has_target = 1 AND processed = 1 AND {_NOACT} AND coalesce(miss_hint, '') = ''")
def _(t):
    return R.miss_pending(t.gz_editions, t.gz_acts, t.gz_mentions)


@query("I15_audit_pending", f"""SELECT e.edition_id, e.pub_date, (SELECT count(*) FROM gz_mentions m WHERE m.edition_id = e.edition_id) AS n_mentions FROM gz_editions e WHERE has_target = 1 AND processed = 1 AND {_NOACT} AND (coalesce(audit, '') = '' OR contains(audit, '"classificacao": "pendente"'))""")
def _(t):
    return R.audit_pending(t.gz_editions, t.gz_acts, t.gz_mentions)


@query("I16_review_counters", f"SELECT count(*) AS total, count(*) FILTER (review IS NULL OR review IN ('', 'pendente')) AS pending, count(*) FILTER (review = 'revisada') AS reviewed, count(*) FILTER (review = 'ignorada') AS ignored FROM gz_editions e WHERE has_target = 1 AND {_NOACT}")
def _(t):
    return R.review_counters(t.gz_editions, t.gz_acts)


@query("I17_anomaly_list", "SELECT act_id, anomaly_reason, e.title AS edition_title, e.pub_date FROM gz_acts JOIN gz_editions e USING (edition_id) WHERE anomaly = 1 ORDER BY act_id DESC")
def _(t):
    return R.anomaly_list(t.gz_acts, t.gz_editions).select("act_id", "anomaly_reason", "edition_title", "pub_date")


@query("I18_facets", """(SELECT 'month' AS facet, key, CAST(NULL AS BIGINT) AS n FROM (SELECT DISTINCT substr(pub_date, 1, 7) AS key FROM gz_acts JOIN gz_editions USING (edition_id) WHERE pub_date IS NOT NULL) ORDER BY key DESC LIMIT 24)
UNION ALL (SELECT 'type', act_type, count(*) FROM gz_acts WHERE trim(coalesce(act_type, '')) <> '' GROUP BY act_type ORDER BY 3 DESC, 2 LIMIT 12)""")
def _(t):
    return R.facets(t.gz_acts, t.gz_editions)


@query("I19_corpus_counters", """SELECT (SELECT count(*) FROM gz_editions) AS editions, (SELECT count(*) FROM gz_editions WHERE processed = 1) AS processed, (SELECT count(*) FROM gz_editions WHERE has_target = 1) AS target, (SELECT count(*) FROM gz_acts) AS acts,
  (SELECT count(*) FROM gz_acts WHERE coalesce(summary, '') <> '') AS enriched_acts, (SELECT count(DISTINCT edition_id) FROM gz_acts) AS editions_with_acts, (SELECT count(DISTINCT edition_id) FROM gz_acts WHERE coalesce(summary, '') <> '') AS editions_enriched,
  (SELECT count(DISTINCT edition_id) FROM gz_acts JOIN gz_editions USING (edition_id) WHERE processed = 1 AND coalesce(summary, '') <> '') AS processed_and_enriched, (SELECT count(*) FROM gz_mentions) AS mentions, (SELECT count(DISTINCT edition_id) FROM gz_mentions) AS editions_with_mentions, (SELECT count(*) FROM gz_jobs) AS jobs""")
def _(t):
    return R.corpus_counters(t.gz_editions, t.gz_acts, t.gz_mentions, t.gz_jobs)


@query("I20_histograms", " UNION ALL ".join(f"SELECT '{n}' AS dim, coalesce(nullif({c}, ''), '(vazio)') AS key, count(*) AS n FROM gz_acts GROUP BY 2" for n, c in (("type", "act_type"), ("organ", "organ"), ("level", "confidence_level"))))
def _(t):
    return R.histograms(t.gz_acts)


@query("I21_backlog_by_month", "SELECT substr(pub_date, 1, 7) AS month, count(*) AS total, count(*) FILTER (processed = 0) AS pending, count(*) FILTER (has_target = 1) AS target FROM gz_editions WHERE pub_date IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 6")
def _(t):
    return R.backlog_by_month(t.gz_editions)


@query("I21_last_editions", "SELECT edition_id, pub_date, processed, has_target, (SELECT count(*) FROM gz_acts a WHERE a.edition_id = e.edition_id) AS n_acts FROM gz_editions e ORDER BY pub_date DESC NULLS LAST, edition_id DESC LIMIT 10")
def _(t):
    return R.last_editions(t.gz_editions, t.gz_acts)


@query("I22_month_report", """WITH j AS (SELECT e.edition_id, e.processed, (SELECT count(*) FROM gz_mentions m WHERE m.edition_id = e.edition_id) AS m, (SELECT count(*) FROM gz_acts a WHERE a.edition_id = e.edition_id) AS a, (SELECT count(*) FROM gz_acts a WHERE a.edition_id = e.edition_id AND coalesce(summary, '') <> '') AS x FROM gz_editions e)
SELECT edition_id, count(*) AS editions, count(*) FILTER (processed = 1) AS processed, CAST(sum(m) AS BIGINT) AS mentions, CAST(sum(a) AS BIGINT) AS acts, CAST(sum(x) AS BIGINT) AS enriched, count(*) FILTER (m > 0) AS with_mentions, count(*) FILTER (a > 0) AS with_acts FROM j GROUP BY ROLLUP (edition_id)""")
def _(t):
    return R.month_report(t.gz_editions, t.gz_acts, t.gz_mentions)


@query("I23_log_errors", "WITH h AS (SELECT event_id AS line_no, upper(event_type) || ' user ' || user_id || ' ' || props AS line FROM events WHERE event_type = 'error') SELECT line_no, line[:200] AS line, (SELECT count(*) FROM h) AS total FROM h ORDER BY line_no DESC LIMIT 30")
def _(t):
    lines = t.events.select(F.col("event_id").alias("line_no"), F.concat(F.upper("event_type"), F.lit(" user "), F.col("user_id").cast("string"), F.lit(" "), "props").alias("line"))
    return R.log_errors(lines)


@query("I24_failed_editions", "SELECT edition_id, pub_date, failures, coalesce(failure_msg, '')[:150] AS message FROM gz_editions WHERE failures > 0 ORDER BY failures DESC, edition_id DESC")
def _(t):
    return R.failed_editions(t.gz_editions)


@query("I24_job_errors", "SELECT job_id, edition_id, status, stage, message[:180] AS message FROM gz_jobs WHERE status IN ('erro', 'falha', 'failed', 'error') OR regexp_matches(lower(coalesce(message, '')), 'error|erro|traceback|exception') ORDER BY job_id DESC LIMIT 25")
def _(t):
    return R.job_errors(t.gz_jobs)


@query("I25_automation_status", f"""WITH j AS (SELECT max(updated_at) AS l, count(*) FILTER (status = 'rodando') AS running, count(*) FILTER (status = 'erro') AS errors FROM gz_jobs),
a AS (SELECT *, coalesce(CAST(epoch(TIMESTAMP '{AS_OF_TS}') - floor(epoch(l)) AS BIGINT) BETWEEN 0 AND 180, false) AS alive FROM j)
SELECT CASE WHEN alive THEN 'ok' ELSE 'degraded' END AS status, alive, running, errors, (SELECT count(*) FROM gz_editions WHERE processed = 0) AS pending, (SELECT count(*) FROM gz_editions WHERE processed = 0 AND failures >= 3) AS quarantined,
  (SELECT least(5, count(*)) FROM gz_editions WHERE processed = 0 AND failures < 3 AND (pub_date IS NULL OR pub_date >= CAST(DATE '{AS_OF_DAY}' - 120 AS VARCHAR))) AS next_cycle,
  concat_ws(',', CASE WHEN NOT alive THEN 'bot_offline' END, CASE WHEN running > 10 THEN 'muitos_jobs_rodando' END) AS problems FROM a""")
def _(t):
    return R.automation_status(t.gz_editions, t.gz_jobs, F.lit(AS_OF_TS).cast("timestamp"), AS_OF_DAY)


@query("I26_backlog_eta", "SELECT pending, least(pending, 40) AS this_run, least(pending, 40) * 2.5::DOUBLE AS eta_min, least(pending, 40) * 5.0::DOUBLE AS eta_max FROM (SELECT count(*) FILTER (processed = 0) AS pending FROM gz_editions)")
def _(t):
    return R.backlog_eta(t.gz_editions, 2.5, 40)


# ---- J -------------------------------------------------------------------------------------

_ALERT = "CASE WHEN notify IS NOT NULL THEN notify = 1 ELSE coalesce(importance, 3) >= 3 END"


@query("J1_acts_to_alert", f"SELECT act_id, edition_id FROM gz_acts WHERE {_ALERT}")
def _(t):
    return J.acts_to_alert(t.gz_acts).select("act_id", "edition_id")


def _short(x: str, n: int) -> str:
    s = Q.squeeze(Q.txt(x))
    return f"CASE WHEN length({s}) <= {n} THEN {s} ELSE {s}[:{n - 3}] || '...' END"


_LINE = f"""'— Pág. ' || page || ': ' || concat_ws(' - ', coalesce(nullif(category, ''), 'publicação'), nullif(organ, ''), nullif(act_type, ''), nullif(number, '')) || CASE WHEN coalesce(doc_date, '') <> '' THEN chr(10) || '  Data: ' || doc_date ELSE '' END
  || CASE WHEN coalesce(value, '') <> '' THEN chr(10) || '  Valor: ' || value ELSE '' END || CASE WHEN coalesce(subject, '') <> '' THEN chr(10) || '  Assunto: ' || {_short('subject', 180)} ELSE '' END || CASE WHEN coalesce(summary, '') <> '' THEN chr(10) || '  IA: ' || {_short('summary', 180)} ELSE '' END"""


@query("J2_alert_message", f"""WITH a AS (SELECT *, {_ALERT} AS al, coalesce(organ, '') <> '' OR coalesce(act_type, '') <> '' OR category = 'publicacao_oficial' AS off FROM gz_acts),
s AS (SELECT edition_id, bool_or(al) AS anya, max(importance) FILTER (al) AS best, bool_or(off) AS o1, bool_or(al AND off) AS o2 FROM a GROUP BY 1),
sh AS (SELECT a.*, row_number() OVER (PARTITION BY a.edition_id ORDER BY page, act_id) AS rn FROM a JOIN s USING (edition_id) WHERE al OR NOT anya),
al AS (SELECT edition_id, string_agg({_LINE}, chr(10) ORDER BY rn) FILTER (rn <= 5) AS lines, count(*) AS n FROM sh GROUP BY 1),
me AS (SELECT edition_id, string_agg('— Pág. ' || page || ': "' || {_short('excerpt', 150)} || '"', chr(10) ORDER BY rn) FILTER (rn <= 10) AS lines, count(*) AS n, array_to_string(list_sort(list(DISTINCT page)), ', ') AS pages, array_to_string(list_sort(list(DISTINCT term)), ', ') AS terms
  FROM (SELECT *, row_number() OVER (PARTITION BY edition_id ORDER BY page, mention_id) AS rn FROM gz_mentions) GROUP BY 1),
an AS (SELECT edition_id, coalesce(string_agg(chr(10) || '• ' || trim(anomaly_reason), '' ORDER BY rn) FILTER (rn <= 3 AND trim(coalesce(anomaly_reason, '')) <> ''), '') AS r FROM (SELECT *, row_number() OVER (PARTITION BY edition_id ORDER BY page, act_id) AS rn FROM a WHERE al AND anomaly = 1) GROUP BY 1),
m AS (SELECT e.edition_id, al.n IS NOT NULL AND NOT s.anya AS sup, s.best, an.r, concat_ws(chr(10), CASE WHEN coalesce(CASE WHEN s.anya THEN o2 ELSE o1 END, false) THEN 'Publicação oficial de NATION_5 detectada!' ELSE 'Menção a NATION_5 detectada (sem publicação oficial identificada)' END, '', 'Edição: ' || e.title,
  'Data: ' || coalesce(e.pub_date, 'não informada'), 'Páginas: ' || coalesce(me.pages, ''), 'Termos: ' || coalesce(me.terms, ''), '', CASE WHEN al.n > 0 THEN 'Publicações classificadas:' || chr(10) || al.lines || CASE WHEN al.n > 5 THEN chr(10) || '— Mais ' || (al.n - 5) || ' publicação(ões) omitida(s).' ELSE '' END || chr(10) END,
  'Trechos encontrados:', me.lines, CASE WHEN me.n > 10 THEN '— Mais ' || (me.n - 10) || ' trecho(s) omitido(s).' END, '', 'Abrir edição: ' || e.url) AS body
  FROM gz_editions e LEFT JOIN s USING (edition_id) LEFT JOIN al USING (edition_id) LEFT JOIN me USING (edition_id) LEFT JOIN an USING (edition_id) WHERE al.n IS NOT NULL OR me.n IS NOT NULL)
SELECT edition_id, coalesce(sup, false) AS suppressed, CASE WHEN r IS NOT NULL THEN 'ANOMALIA DETECTADA' || r || chr(10) || chr(10) ELSE '' END || CASE WHEN NOT coalesce(sup, false) AND coalesce(best, 0) > 0 THEN 'Importância ' || best || '/5' || chr(10) || chr(10) ELSE '' END || body
  || CASE WHEN sup THEN chr(10) || chr(10) || '[suprimido: importancia < limiar / notificar=false]' ELSE '' END AS message FROM m""")
def _(t):
    return J.alert_messages(t.gz_editions, t.gz_acts, t.gz_mentions, "NATION_5")


@query("J3_alert_payload", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY edition_id ORDER BY act_id) AS rn FROM gz_acts), n AS (SELECT edition_id, count(*) AS na FROM gz_acts GROUP BY 1), m AS (SELECT edition_id, count(*) AS nm FROM gz_mentions GROUP BY 1),
p AS (SELECT edition_id, string_agg('{"id":' || act_id || coalesce(',"tipo":"' || act_type || '"', '') || coalesce(',"numero":"' || number || '"', '') || coalesce(',"importancia":' || importance, '') || ',"confianca":' || confidence || coalesce(',"confianca_nivel":"' || confidence_level || '"', '') || '}', ',' ORDER BY rn) AS items FROM a WHERE rn <= 10 GROUP BY 1)
SELECT p.edition_id, '{"edicao_id":' || p.edition_id || ',"edicao_titulo":"' || e.title || '","publicacoes":' || na || ',"mencoes":' || coalesce(nm, 0) || ',"url":"' || url || '","publicacoes_resumo":[' || items || ']}' AS payload FROM p JOIN n USING (edition_id) LEFT JOIN m USING (edition_id) JOIN gz_editions e USING (edition_id)""")
def _(t):
    return J.alert_payload(t.gz_editions, t.gz_acts, t.gz_mentions)


@query("J4_absence_alert", "SELECT n AS n_target, n = 0 AS due, CASE WHEN n = 0 THEN 'Alerta de ausência — Nenhuma publicação oficial de NATION_5 foi detectada nos últimos 30 dias.' END AS message FROM (SELECT count(*) AS n FROM gz_editions WHERE has_target = 1 AND pub_date >= CAST(DATE '2001-09-01' - 30 AS VARCHAR))")
def _(t):
    return J.absence_alert(t.gz_editions, AS_OF_DAY, 30, "NATION_5")


@query("J5_mark_notified", f"SELECT mention_id, edition_id, CASE WHEN edition_id IN (SELECT edition_id FROM gz_acts WHERE {_ALERT}) THEN 1 ELSE notified END AS notified FROM gz_mentions")
def _(t):
    return J.mark_notified(t.gz_mentions, J.acts_to_alert(t.gz_acts)).select("mention_id", "edition_id", "notified")


@query("J5_notification_log", "SELECT edition_id, 'arquivo' AS channel, 'atos: ' || count(*) AS content, CAST(1 AS INTEGER) AS success, '2001-09-01' AS day, any_value(e.title) AS edition_title, any_value(e.pub_date) AS pub_date FROM gz_acts JOIN gz_editions e USING (edition_id) GROUP BY 1 ORDER BY edition_id DESC LIMIT 100")
def _(t):
    """Written to a table and read back."""
    n = t.gz_acts.groupBy("edition_id").agg(F.concat(F.lit("atos: "), F.count("*").cast("string")).alias("message"))
    path = t.scratch("notifications")
    J.append_notifications(J.notification_log(n, AS_OF_DAY), path)
    log = t.spark.read.parquet(path).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return J.list_notifications(log, t.gz_editions)


@query("I13_latest_actions", "SELECT event_id AS action_id, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS at, user_id AS cycle, event_type AS action, CASE WHEN event_type = 'error' THEN 'erro' ELSE 'info' END AS level, props AS detail FROM events ORDER BY event_id DESC LIMIT 30")
def _(t):
    log = t.events.select(F.col("event_id").alias("action_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("user_id").alias("cycle"), F.col("event_type").alias("action"),
                          F.when(F.col("event_type") == "error", "erro").otherwise("info").alias("level"), F.col("props").alias("detail"))
    return R.latest_actions(log)
