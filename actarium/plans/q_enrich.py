"""F-operators: enrichment answers merged into acts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import enrichment as N
from ..functions.text import text
from ..operators import search as H
from . import sqlx as Q
from .q_search import ROWS_CTE
from .projections import CONFIG
from .q_detect import anchored_sql, preferred_sql
from .q_functions import norm_date_sql, variants_sql
from .registry import query

_STR = ("acao", "texto_corrigido", "orgao", "tipo", "numero", "data_documento", "assunto", "valor", "resumo", "classificacao")
_PARSED = "par AS (SELECT act_id, json_valid(j) AND NOT contains(j, ',}') AS ok, " + ", ".join(f"j ->> '$.{k}' AS {k}" for k in _STR) + """,
  CAST(j ->> '$.pertence_a_alvo' AS BOOLEAN) AS pertence_a_alvo, CAST(j ->> '$.tem_mencao_alvo' AS BOOLEAN) AS tem_mencao_alvo, CAST(j ->> '$.importancia' AS INTEGER) AS r_importancia,
  CAST(j ->> '$.notificar' AS BOOLEAN) AS notificar, CAST(j ->> '$.i' AS INTEGER) AS i, j ->> '$.partes.contratada' AS contratada, from_json(j -> '$.temas', '["VARCHAR"]') AS l_temas, from_json(j -> '$.tags', '["VARCHAR"]') AS l_tags
  FROM (SELECT act_id, CASE WHEN json_valid(response) THEN response ELSE response || '}' END AS j FROM gz_responses))"""


@query("F1_route_triage", f"""WITH {_PARSED} SELECT act_id, CASE WHEN trim(lower(acao)) IN ('descartar', 'discard', 'rejeitar') THEN 'discard' WHEN trim(lower(acao)) IN ('so_mencao', 'so-mencao', 'mencao') THEN 'mention_only' ELSE 'keep' END AS route FROM par""")
def _(t):
    return N.route_triage(N.parse_responses(t.spread("gz_responses"))).select("act_id", "route")


_FO = Q.fold("orgao")
REASON = f"""CASE WHEN pertence_a_alvo = false THEN 'not_ours' WHEN tem_mencao_alvo = false THEN 'no_mention'
  WHEN coalesce(orgao, '') <> '' AND NOT contains({_FO}, 'nation_5') AND {Q.any_of(_FO, (*Q.NEIGHBOURS, *fixed.FOREIGN_ORGAN_PHRASES))} THEN 'foreign_organ' END"""


@query("F2_gate_enriched", f"WITH {_PARSED} SELECT act_id, {REASON} AS drop_reason FROM par")
def _(t):
    return N.gate_enriched(N.parse_responses(t.spread("gz_responses")), CONFIG).select("act_id", "drop_reason")


@query("F2_gate_counts", f"WITH {_PARSED}, r AS (SELECT {REASON} AS x FROM par) SELECT count(x) AS model_drops, count(*) FILTER (x IN ('not_ours', 'foreign_organ')) AS neighbour_drops FROM r")
def _(t):
    return N.gate_counts(N.gate_enriched(N.parse_responses(t.spread("gz_responses")), CONFIG))


def tight(x: str) -> str:
    return f"replace({Q.fold(Q.txt(x))}, ' ', '')"


def value_anchored_sql(v: str, x: str) -> str:
    c, d = tight(Q.strip(Q.txt(v))), Q.digits(x)
    return f"""(CASE WHEN NOT {Q.nonblank(v)} THEN true WHEN coalesce({x}, '') = '' THEN false ELSE (length({c}) >= 4 AND contains({tight(x)}, {c}))
      OR ({d} <> '' AND len(list_filter({variants_sql(v)}, lambda v1: contains({d}, v1))) > 0) END)"""


def field_anchored_sql(v: str, x: str) -> str:
    c = Q.strip(Q.txt(v))
    t, tx = Q.significant(c), Q.significant(x)
    return f"""(CASE WHEN NOT {Q.nonblank(v)} THEN true WHEN coalesce({x}, '') = '' THEN false
      WHEN contains({Q.fold(c)}, 'r$') OR regexp_matches({c}, '\\d+[.,]\\d{{2}}|\\d{{1,3}}(?:\\.\\d{{3}})+') THEN {value_anchored_sql(c, x)}
      WHEN length({tight(c)}) >= 4 AND contains({tight(x)}, {tight(c)}) THEN true WHEN len({t}) = 0 THEN true ELSE len(list_intersect({t}, {tx})) / len({t}) >= 0.35 END)"""


@query("F4_value_anchored", f"SELECT act_id, {value_anchored_sql('value', 'excerpt')} AS anchored, {value_anchored_sql('value', 'summary')} AS in_summary FROM gz_acts")
def _(t):
    return t.spread("gz_acts").select("act_id", N.value_anchored("value", "excerpt").alias("anchored"), N.value_anchored("value", "summary").alias("in_summary"))


@query("F5_field_anchored", f"SELECT act_id, {field_anchored_sql('organ', 'excerpt')} AS organ_ok, {field_anchored_sql('number', 'summary')} AS number_ok, {field_anchored_sql('subject', 'summary')} AS subject_ok FROM gz_acts")
def _(t):
    return t.spread("gz_acts").select("act_id", N.field_anchored("organ", "excerpt").alias("organ_ok"), N.field_anchored("number", "summary").alias("number_ok"),
                                      N.field_anchored("subject", "summary").alias("subject_ok"))


_ANCHOR = f"""(CASE WHEN length({Q.strip('excerpt')}) < 80 AND {Q.strip(Q.txt('texto_corrigido'))} <> '' THEN {Q.strip('excerpt')} || chr(10) || {Q.strip('texto_corrigido')} ELSE {Q.strip('excerpt')} END)"""
_CH = ("orgao", "tipo", "numero", "valor", "data_documento")
VALID_CTE = f"""{_PARSED}, va0 AS (SELECT a.*, p.* EXCLUDE (act_id), {_ANCHOR} AS anc FROM gz_acts a LEFT JOIN (SELECT * FROM par WHERE ok) p USING (act_id)),
va1 AS (SELECT *, {', '.join((value_anchored_sql(c, 'anc') if c == 'valor' else field_anchored_sql(c, 'anc')) + f' AS ok_{c}' for c in _CH)}, {Q.valid_number('numero')} AS cn FROM va0),
va AS (SELECT * REPLACE ({', '.join(f"CASE WHEN ok_{c} THEN {'cn' if c == 'numero' else c} END AS {c}" for c in _CH)}),
  array_to_string(list_filter([{', '.join(f"CASE WHEN NOT ok_{c} THEN '{c}' END" for c in _CH)}, CASE WHEN ok_numero AND coalesce(numero, '') <> '' AND cn IS NULL THEN 'numero' END], lambda r: r IS NOT NULL), ',') AS rejected FROM va1)"""


@query("F6_validate_fields", f"WITH {VALID_CTE} SELECT act_id, {', '.join(_CH)}, rejected, rejected = '' AS valid FROM va")
def _(t):
    j = t.spread("gz_acts").join(N.parse_responses(t.spread("gz_responses")).where("ok"), "act_id", "left")
    return N.validate_fields(j).select("act_id", *_CH, F.array_join("rejected", ",").alias("rejected"), "valid")


def pref_pick(cand: str, ft: str, kind: str) -> str:
    own = f"(contains({kind}, 'extrato') AND regexp_matches({ft}, 'extrato\\s+(?:do\\s+|de\\s+)?contrato\\s+n[o°.]?\\s*' || string_split(n, '/')[1]))"
    return f"""(SELECT n FROM (SELECT unnest({cand}) AS n, generate_subscripts({cand}, 1) AS i) ORDER BY {own} DESC, CASE WHEN {own} THEN -i ELSE coalesce(try_cast(CASE WHEN contains(n, '/') THEN string_split(n, '/')[-1] END AS INTEGER), 0) END DESC, i LIMIT 1)"""


def resolve_number_cte(src: str, kind: str, number: str, excerpt: str, corrected: str, summary: str, out: str) -> str:
    """CTE chain adding column rnum to src."""
    f = {k: Q.fold(Q.scan(x)) for k, x in (("fe", excerpt), ("fc", corrected), ("fs", summary))}
    return f"""{out}0 AS (SELECT *, {Q.fold(Q.txt(kind))} AS kk, {', '.join(f'{v} AS {k}' for k, v in f.items())} FROM {src}),
{out}1 AS (SELECT *, {', '.join(f"{preferred_sql(k, 'kk')} AS c{k}" for k in f)} FROM {out}0),
{out} AS (SELECT *, coalesce({', '.join(pref_pick('c' + k, k, 'kk') for k in f)}, CASE WHEN {anchored_sql(number, f"concat_ws(chr(10), nullif({excerpt}, ''), nullif({summary}, ''), nullif({corrected}, ''))")} THEN {Q.valid_number(number)} END) AS rnum FROM {out}1)"""


def summary_value_sql(x: str) -> str:
    return Q.norm_money(f"coalesce(nullif(regexp_extract({Q.txt(x)}, 'R\\$\\s*[\\d.]+,\\d{{2}}'), ''), nullif(regexp_extract({Q.txt(x)}, 'R\\$\\s*[\\d.,]+'), ''))")


def resolve_value_sql(v: str, e: str, s: str, c: str) -> str:
    n = Q.norm_money(v)
    plain = f"replace({tight(n)}, 'r$', '')"
    d = Q.digits(n)
    cut = f"CASE WHEN suffix({d}, '00') AND length({d}) > 3 THEN {d}[:-3] END"
    by_d = " OR ".join(f"contains({Q.digits(b)}, {d}) OR coalesce(contains({Q.digits(b)}, {cut}), false)" for b in (e, s, c))
    return f"""coalesce(CASE WHEN ({plain} <> '' AND (contains({tight(e)}, {plain}) OR contains({tight(s)}, {plain}))) OR (length({d}) >= 3 AND ({by_d})) THEN {n} END,
      {summary_value_sql(s)}, {Q.norm_money(f"nullif(regexp_extract({Q.txt(e)}, 'R\\$\\s*[\\d.]+,\\d{{2}}'), '')")})"""


@query("F7_resolve_number_value", f"""WITH {resolve_number_cte('gz_acts', 'act_type', 'number', 'excerpt', 'NULL', 'summary', 'rn')}
SELECT act_id, rnum AS number, {resolve_value_sql('value', 'excerpt', 'summary', 'NULL')} AS value FROM rn""")
def _(t):
    none = F.lit(None).cast("string")
    return t.spread("gz_acts").select("act_id", N.resolve_number("act_type", "number", "excerpt", none, "summary", CONFIG).alias("number"),
                                      N.resolve_value("value", "excerpt", "summary", none).alias("value"))


def party_sql(name: str, blob: str) -> str:
    out = name
    for wrong, right, _, rep in fixed.PARTY_REPAIRS:
        pat = {"emas": r"(?i)\bEmas\b", "fernande": r"(?i)\bFernande\b"}[wrong]
        out = f"CASE WHEN contains({Q.fold(name)}, '{wrong}') AND contains({blob}, '{right}') THEN regexp_replace({out}, {Q.lit(pat)}, '{rep}', 'g') ELSE {out} END"
    return f"(CASE WHEN coalesce({name}, '') <> '' THEN {out} END)"


@query("F8_sanitize_parties", f"""SELECT act_id, {party_sql("contr", Q.fold("excerpt || ' ' || coalesce(summary, '') || who"))} AS contractor FROM (
  SELECT *, 'Lourdes Emas Fernande' AS contr, CASE WHEN act_id % 2 = 0 THEN ' Sra. Elias' ELSE ' Fernandes' END AS who FROM gz_acts)""")
def _(t):
    who = F.when(F.col("act_id") % 2 == 0, " Sra. Elias").otherwise(" Fernandes")
    return t.gz_acts.select("act_id", N.sanitize_party(F.lit("Lourdes Emas Fernande"), "excerpt", F.concat(text("summary"), who)).alias("contractor"))


def importance_sql(*x: str) -> str:
    n = Q.fold(" || ' ' || ".join(Q.txt(c) for c in x))
    v = x[-1]
    w = lambda ws, k: f"CASE WHEN {Q.any_of(n, ws)} THEN {k} ELSE 2 END"
    return f"""greatest({w(fixed.IMPORTANCE_CONTRACT, 4)}, {w(fixed.IMPORTANCE_FISCAL, 4)}, {w(fixed.IMPORTANCE_STAFF, 3)}, CASE WHEN coalesce({v}, '') <> '' THEN CASE WHEN length({Q.digits(v)}) >= 7 THEN 5 ELSE 3 END ELSE 2 END)"""


@query("F9_importance", f"SELECT act_id, CAST({importance_sql('act_type', 'subject', 'summary', 'value')} AS INTEGER) AS importance FROM gz_acts")
def _(t):
    return t.gz_acts.select("act_id", N.importance("act_type", "subject", "summary", "value").alias("importance"))


def checklist_sql(kind: str, num: str, date: str, val: str, org: str, subj: str, exc: str, p: str = "") -> str:
    req = Q.any_of(Q.fold(Q.txt(kind)), fixed.VALUE_REQUIRED)
    m = {"numero": Q.filled(num), "data": Q.filled(date), "valor": f"({Q.filled(val)} OR NOT {req})", "orgao": Q.filled(org), "objeto": Q.filled(subj),
         "fundamentacao": f"regexp_matches(lower({Q.txt(exc)}), {Q.lit(fixed.LEGAL_BASIS)})"}
    miss = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT {e} THEN '{k}' END" for k, e in m.items()) + "], lambda c0: c0 IS NOT NULL), ',')"
    n = " + ".join(f"{e}::INT" for e in m.values())
    return f"{miss} AS {p}missing, CAST(round(100 * ({n}) / 6.0) AS INTEGER) AS {p}score, {req} AS {p}value_required"


@query("F10_checklist", f"SELECT act_id, {checklist_sql('act_type', 'number', 'doc_date', 'value', 'organ', chr(99) + 'oalesce(nullif(subject, ' + chr(39) * 2 + '), summary)', 'excerpt')} FROM gz_acts")
def _(t):
    c = N.checklist("act_type", "number", "doc_date", "value", "organ", F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.col("summary")), "excerpt")
    return t.gz_acts.select("act_id", c.alias("c")).select("act_id", F.array_join("c.missing", ",").alias("missing"), "c.score", "c.value_required")


_RES = "coalesce(nullif(n.resumo, ''), NULL)"


@query("F3_merge_enrichment", f"""WITH {VALID_CTE},
m0 AS (SELECT *, coalesce(ok, false) AS hit FROM va WHERE ({REASON}) IS NULL),
m1 AS (SELECT *, CASE WHEN hit THEN coalesce(nullif(texto_corrigido, ''), excerpt) END AS corr, CASE WHEN hit THEN resumo ELSE summary END AS n_sum,
  CASE WHEN hit THEN {Q.act_type("coalesce(nullif(tipo, ''), act_type)")} ELSE act_type END AS n_type, CASE WHEN hit THEN coalesce({Q.organ('orgao')}, organ) ELSE organ END AS n_org,
  CASE WHEN hit THEN coalesce(nullif(assunto, ''), subject) ELSE subject END AS n_subj, coalesce(nullif(numero, ''), number) AS g_num, coalesce(nullif(valor, ''), value) AS g_val,
  CASE WHEN hit THEN coalesce({norm_date_sql('data_documento')}, nullif(doc_date, ''), {norm_date_sql('resumo')}, {norm_date_sql('excerpt')}) ELSE doc_date END AS n_date FROM m0),
{resolve_number_cte('m1', 'n_type', 'g_num', 'excerpt', 'corr', 'n_sum', 'm2')},
m3 AS (SELECT *, CASE WHEN hit THEN rnum ELSE number END AS n_num, CASE WHEN hit THEN {resolve_value_sql('g_val', 'excerpt', 'n_sum', 'corr')} ELSE value END AS n_val,
  CASE WHEN hit THEN CASE WHEN r_importancia BETWEEN 1 AND 5 THEN r_importancia ELSE {importance_sql('n_type', 'n_subj', 'n_sum', "coalesce(nullif(value, ''), valor)")} END ELSE importance END AS n_imp,
  coalesce((SELECT array_to_string(list(th ORDER BY p)[:5], ', ') FROM (SELECT th, min(p) AS p FROM (SELECT {Q.theme('x')} AS th, p FROM (SELECT unnest(coalesce(l_temas, l_tags)) AS x, generate_subscripts(coalesce(l_temas, l_tags), 1) AS p)) WHERE th IS NOT NULL GROUP BY th) HAVING count(*) > 0), themes) AS n_th,
  {party_sql('contratada', Q.fold("coalesce(excerpt, '') || ' ' || coalesce(n_sum, '') || ' ' || coalesce(corr, '')"))} AS contractor FROM m2)
SELECT act_id, n_org AS organ, n_type AS act_type, n_num AS number, n_date AS doc_date, n_subj AS subject, n_val AS value, n_sum AS summary, CAST(n_imp AS INTEGER) AS importance, n_th AS themes,
  CASE WHEN hit THEN coalesce(notificar::INT, (n_imp >= 3)::INT) ELSE notify END AS notify, corr AS corrected_text, contractor, array_to_string(l_tags[1:3], ', ') AS tags, rejected, hit AS answered,
  {checklist_sql('n_type', "coalesce(nullif(n_num, ''), numero)", "coalesce(nullif(n_date, ''), data_documento)", "coalesce(nullif(n_val, ''), valor)", 'n_org', "coalesce(nullif(n_subj, ''), n_sum)", 'excerpt')} FROM m3""")
def _(t):
    m = N.merge_enrichment(t.spread("gz_acts"), t.spread("gz_responses"), CONFIG)
    return m.select("act_id", "organ", "act_type", "number", "doc_date", "subject", "value", "summary", "importance", "themes", "notify", "corrected_text", "contractor", "tags",
                    F.array_join("rejected", ",").alias("rejected"), "answered", F.array_join("checklist.missing", ",").alias("missing"), "checklist.score", "checklist.value_required")


@query("F11_value_history", f"""SELECT act_type, rank, act_id, amount FROM (SELECT act_type, CAST(row_number() OVER (PARTITION BY act_type ORDER BY act_id DESC) AS INTEGER) AS rank, act_id, {Q.parse_money('value')} AS amount
  FROM gz_acts WHERE trim(coalesce(act_type, '')) <> '' AND coalesce(value, '') <> '') WHERE rank <= 80 AND amount > 0""")
def _(t):
    return N.value_history(t.gz_acts)


@query("F12_anomalies", f"""
WITH v AS (SELECT act_id, trim(coalesce(act_type, '')) AS kind, {Q.parse_money('value')} AS a, coalesce(importance, 0) AS imp, notify FROM gz_acts WHERE coalesce(value, '') <> ''),
h AS (SELECT *, list(a) OVER (PARTITION BY kind ORDER BY act_id ROWS BETWEEN 80 PRECEDING AND 1 PRECEDING) AS hist FROM v),
m AS (SELECT *, CASE WHEN kind <> '' THEN list_sort(list_filter(hist, lambda x: x > 0)) END AS s FROM h),
k AS (SELECT *, CASE WHEN len(s) >= 5 THEN CASE WHEN len(s) % 2 = 1 THEN s[len(s) // 2 + 1] ELSE (s[len(s) // 2] + s[len(s) // 2 + 1]) / 2 END END AS med FROM m),
r AS (SELECT *, list_filter([CASE WHEN a >= 100000 AND {Q.any_of(Q.fold('kind'), fixed.ANOMALY_TYPES)} THEN 'valor alto R$ ' || translate(format('{{:,.2f}}', a), ',.', '.,') END,
  CASE WHEN med > 0 AND a >= 3.0 * med THEN 'valor ' || format('{{:.1f}}', a / med) || '× a mediana do tipo (' || replace(format('{{:,.0f}}', med), ',', '.') || ')' END,
  CASE WHEN imp >= 5 AND a >= 50000 THEN 'importância máxima com valor elevado' END], lambda x: x IS NOT NULL) AS rs FROM k)
SELECT act_id, CAST(len(rs) > 0 AS INTEGER) AS anomaly, nullif(array_to_string(rs, '; '), '') AS reason, CASE WHEN len(rs) > 0 AND notify = 0 THEN 1 ELSE notify END AS notify FROM r""")
def _(t):
    return N.anomalies(t.gz_acts)


_BLOB = Q.fold(" || ' ' || ".join(Q.txt(c) for c in ("act_type", "themes", "subject", "summary", "excerpt")))


@query("F13_fiscal_radar", f"SELECT act_id, {Q.any_of(_BLOB, fixed.FISCAL_KEYS)} AS fiscal FROM gz_acts")
def _(t):
    return t.gz_acts.select("act_id", N.is_fiscal("act_type", "themes", "subject", "summary", "excerpt").alias("fiscal"))


@query("F13_fiscal_listing", f"""SELECT a.act_id, a.act_type, e.title AS edition_title, e.pub_date FROM gz_acts a JOIN gz_editions e USING (edition_id)
WHERE {Q.any_of(Q.fold(Q.txt('act_type')), ('rgf', 'rreo', 'lrf', 'balanc', 'demonstrat', 'fiscal'))} OR contains(lower({Q.txt('themes')}), 'fiscal') OR contains({Q.fold(Q.txt('subject'))}, 'lrf') OR contains({Q.fold(Q.txt('summary'))}, 'gestao fiscal')
ORDER BY pub_date DESC NULLS LAST, act_id DESC""")
def _(t):
    return N.fiscal_listing(t.gz_acts, t.gz_editions).select("act_id", "act_type", "edition_title", "pub_date")


@query("F14_context_audit", """SELECT edition_id, string_agg('pág.' || page || ': ' || excerpt[:400], chr(10) || '---' || chr(10) ORDER BY rn) AS context, count(*) AS n_items
FROM (SELECT *, row_number() OVER (PARTITION BY edition_id ORDER BY page, mention_id) AS rn FROM gz_mentions) WHERE rn <= 8 GROUP BY 1""")
def _(t):
    return N.audit_context(t.gz_mentions)


@query("F14_context_triage", """SELECT edition_id, string_agg('[' || rn || '] pág=' || page || ' termo=' || term || chr(10) || excerpt[:350], chr(10) || '---' || chr(10) ORDER BY rn) AS context, count(*) AS n_items
FROM (SELECT *, row_number() OVER (PARTITION BY edition_id ORDER BY page, mention_id) AS rn FROM gz_mentions) WHERE rn <= 15 GROUP BY 1""")
def _(t):
    return N.triage_context(t.gz_mentions)


@query("F14_context_timeline", """SELECT number, string_agg('[' || rn || '] ' || coalesce(pub_date, doc_date, '?') || ' | ' || concat_ws(' ', act_type, coalesce(number, '')) || ' | ' || coalesce(organ, '') || ' | ' || coalesce(value, '') || ' | ' ||
  coalesce(nullif(summary, ''), subject, '')[:120], chr(10) ORDER BY rn) AS context, count(*) AS n_items
FROM (SELECT a.*, e.pub_date, row_number() OVER (PARTITION BY number ORDER BY e.pub_date NULLS FIRST, act_id) AS rn FROM gz_acts a JOIN gz_editions e USING (edition_id) WHERE number IS NOT NULL) WHERE rn <= 12 GROUP BY 1""")
def _(t):
    j = t.gz_acts.where("number is not null").join(t.gz_editions.select("edition_id", "pub_date"), "edition_id")
    return N.timeline_context(j)


# the questions are the benchmark texts
@query("F14_context_question", f"""WITH {ROWS_CTE}, q AS (SELECT item_id AS query_id, tok, count(*) AS m FROM (SELECT item_id, unnest(regexp_extract_all({Q.fold('text')}, '[a-z0-9]{{2,}}')) AS tok FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, act_id, any_value(day) AS day, any_value(boost) + sum(CASE WHEN contains(b, tok) THEN m * (30 + 3 * CAST((length(b) - length(replace(b, tok, ''))) // length(tok) AS BIGINT)) ELSE 0 END) AS s FROM q, rows GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, day, act_id DESC) AS rank FROM s WHERE s > 0) WHERE rank <= 8)
SELECT query_id, string_agg('[' || rank || '] id=' || act_id || ' tipo=' || coalesce(act_type, '') || ' num=' || coalesce(number, '') || chr(10) || 'resumo=' || coalesce(nullif(summary, ''), subject, '') || chr(10) || 'trecho=' || coalesce(excerpt, '')[:500], chr(10) || chr(10) ORDER BY rank) AS context,
  count(*) AS n_items FROM t JOIN gz_acts a USING (act_id) GROUP BY 1""")
def _(t):
    acts = H.with_edition(t.spread("gz_acts"), t.gz_editions)
    ranked = H.rank_acts_many(acts, t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 8)
    return N.question_context(ranked.join(t.gz_acts, "act_id"))


def _similar(t, asked="true"):
    """The acts like those that `asked` chooses, which is every act unless said otherwise."""
    acts = H.with_edition(t.spread("gz_acts"), t.gz_editions)
    return N.similar_items(acts, H.similar_acts(acts, acts.where(asked), 6).drop("score"))


def _like(where: str = "", scores: str = "") -> str:
    """The six acts most like each act that `where` leaves, as common table expressions; scores: from q to s."""
    return f"""{ROWS_CTE}, q0 AS (SELECT act_id AS query_id, concat_ws(' ', nullif(act_type, ''), nullif(organ, ''), coalesce(nullif(subject, ''), nullif(summary, '')), nullif(themes, '')) AS x FROM gz_acts JOIN gz_editions e USING (edition_id){where}),
q AS (SELECT query_id, tok, count(*) AS m FROM (SELECT query_id, unnest(regexp_extract_all({Q.fold('x')}, '[a-z0-9]{{2,}}')) AS tok FROM q0) GROUP BY ALL),
{scores or _SCORES},
newest AS (SELECT act_id, row_number() OVER (ORDER BY e.pub_date DESC NULLS LAST, act_id DESC) AS place FROM gz_acts JOIN gz_editions e USING (edition_id)),
it AS (SELECT query_id, act_id AS cited_id, idx FROM (SELECT query_id, act_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, day, act_id DESC) AS idx FROM s WHERE s > 0) WHERE idx <= 6
  UNION ALL SELECT * FROM (SELECT query_id, act_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS idx FROM q0, (SELECT * FROM newest WHERE place <= 7) n WHERE act_id <> query_id AND query_id NOT IN (SELECT query_id FROM q)) WHERE idx <= 6)"""


_SCORES = """s AS (SELECT query_id, act_id, any_value(day) AS day, any_value(boost) + sum(CASE WHEN contains(b, tok) THEN m * (30 + 3 * CAST((length(b) - length(replace(b, tok, ''))) // length(tok) AS BIGINT)) ELSE 0 END) AS s FROM q, rows WHERE act_id <> query_id GROUP BY ALL)"""
# the same scores for every act: an act holds its points for every token once, so that a pair adds up those of its tokens; of each
# act the seven best are ordered (it may be one of them)
_ALL_SCORES = """tk AS (SELECT tok, row_number() OVER (ORDER BY tok) AS i FROM (SELECT DISTINCT tok FROM q)),
placed AS (SELECT *, row_number() OVER (ORDER BY day DESC, act_id) AS o FROM rows),
pts AS (SELECT o, boost, list(p ORDER BY i) AS ps FROM (SELECT o, boost, i, CASE WHEN contains(b, tok) THEN 30 + 3 * CAST((length(b) - length(replace(b, tok, ''))) // length(tok) AS BIGINT) ELSE 0 END AS p FROM tk, placed) GROUP BY ALL),
asked AS (SELECT query_id, list(i) AS ii FROM (SELECT query_id, i, unnest(range(m)) FROM q JOIN tk USING (tok)) GROUP BY 1),
best AS (SELECT query_id, unnest(max((boost + list_sum(list_select(ps, ii)))::BIGINT * 4294967296 + o, 7)) AS k FROM asked, pts GROUP BY 1),
s AS (SELECT query_id, act_id, day, k // 4294967296 AS s FROM best JOIN placed ON o = k % 4294967296 WHERE act_id <> query_id)"""


@query("F14_context_similar", f"""WITH {_like(scores=_ALL_SCORES)}
SELECT it.query_id AS act_id, string_agg('[' || idx || '] id=' || cited_id || ' ' || coalesce(act_type, '') || ' ' || coalesce(number, '') || ' ' || coalesce(organ, '') || ' valor=' || coalesce(nullif(value, ''), '—') || ' data=' || coalesce(e.pub_date, doc_date, '?') || chr(10) ||
  coalesce(nullif(summary, ''), subject, '')[:180], chr(10) ORDER BY idx) AS context, count(*) AS n_items FROM it JOIN gz_acts a ON a.act_id = it.cited_id JOIN gz_editions e USING (edition_id) GROUP BY 1""")
def _(t):
    return N.similar_context(_similar(t))


# the stand-in answers cite the numbers 1 + id % 9 and 3, and one text that is no number
@query("F15_citations", f"""WITH {_like(' WHERE act_id % 100 = 0')}, an AS (SELECT query_id, unnest(['' || (1 + (query_id // 100) % 9), 'x', '3']) AS c, generate_subscripts([1, 2, 3], 1) - 1 AS place FROM q0)
SELECT an.query_id AS act_id, CAST(place AS INTEGER) AS place, cited_id, a.edition_id, a.act_type, a.number FROM an JOIN it ON it.query_id = an.query_id AND it.idx = try_cast(an.c AS INTEGER) JOIN gz_acts a ON a.act_id = it.cited_id""")
def _(t):
    i = F.col("act_id")
    answers = t.gz_acts.where("act_id % 100 = 0").select("act_id", F.array((1 + F.floor(i / 100) % 9).cast("string"), F.lit("x"), F.lit("3")).alias("cited"))
    return N.citations(answers, _similar(t, "act_id % 100 = 0"))


@query("F15_clean_pages", """WITH s AS (SELECT edition_id, list(CASE WHEN mention_id % 3 = 0 THEN 'p' || page ELSE '' || page END ORDER BY page, mention_id) FILTER (edition_id % 4 > 0) AS said, list(page ORDER BY page, mention_id) AS pages FROM gz_mentions GROUP BY 1),
c AS (SELECT edition_id, list_filter(list_transform(coalesce(said, []), lambda x: try_cast(x AS INTEGER)), lambda p: p IS NOT NULL) AS good, pages FROM s)
SELECT edition_id, array_to_string(CASE WHEN len(good) > 0 THEN good[1:8] ELSE pages[1:5] END, ',') AS pages FROM c""")
def _(t):
    m = t.gz_mentions
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("page", "mention_id", c.alias("x")))), lambda s: s["x"])
    said = F.when(F.col("mention_id") % 3 == 0, F.concat(F.lit("p"), F.col("page").cast("string"))).otherwise(F.col("page").cast("string"))
    g = m.groupBy("edition_id").agg(ordered(said).alias("said"), ordered(F.col("page")).alias("pages"))
    suggested = F.when(F.col("edition_id") % 4 > 0, F.col("said")).otherwise(F.array().cast("array<string>"))
    return g.select("edition_id", F.array_join(F.transform(N.clean_pages(suggested, F.col("pages")), lambda p: p.cast("string")), ",").alias("pages"))


@query("F15_align_indexed", f"""WITH {_PARSED}, it AS (SELECT edition_id, CAST(row_number() OVER (PARTITION BY edition_id ORDER BY page, mention_id) AS INTEGER) AS idx, mention_id, page, excerpt FROM gz_mentions),
an AS (SELECT a.edition_id, p.i AS idx, arg_max_null(p.classificacao, p.act_id) AS c FROM par p JOIN gz_acts a USING (act_id) WHERE p.ok AND p.i IS NOT NULL GROUP BY ALL)
SELECT it.edition_id, idx, mention_id, page, excerpt[:200] AS excerpt, lower(coalesce(nullif(c, ''), 'outro')) AS "class" FROM it LEFT JOIN an USING (edition_id, idx)""")
def _(t):
    from pyspark.sql import Window
    m = t.gz_mentions
    items = m.withColumn("idx", F.row_number().over(Window.partitionBy("edition_id").orderBy("page", "mention_id")))
    answers = N.parse_responses(t.spread("gz_responses")).where("ok").join(t.gz_acts.select("act_id", "edition_id"), "act_id").withColumn("seq", F.col("act_id"))
    return N.align_indexed(items, answers).drop("score")


@query("F16_retry_pending", f"""WITH {VALID_CTE} SELECT act_id, edition_id, CASE WHEN ({REASON}) IS NOT NULL THEN 'discarded' WHEN coalesce(CASE WHEN coalesce(ok, false) THEN resumo ELSE summary END, '') <> '' THEN 'updated' ELSE 'kept' END AS outcome
FROM va WHERE enriched = 0 OR coalesce(summary, '') = ''""")
def _(t):
    return N.retry_pending(t.spread("gz_acts"), t.spread("gz_responses"), CONFIG)


@query("F17_pending_enrichment", "SELECT act_id, edition_id FROM gz_acts WHERE enriched = 0 OR coalesce(summary, '') = '' ")
def _(t):
    return N.pending_enrichment(t.gz_acts).select("act_id", "edition_id")
