"""H-operators: queues and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import search as H
from . import sqlx as Q
from .projections import AS_OF_DAY, CONFIG
from .registry import query

KEY = "nation_5"


def signs_sql(n: str) -> str:
    """Signs of a folded text as columns."""
    d = Q.digits(n)
    named = f"(regexp_matches({n}, '\\b{KEY}\\b') OR contains({n}, '{KEY}-pr') OR contains({n}, '{KEY}/pr'))"
    found = {"ours": f"contains({n}, '{KEY}')", "named": named, "weak": f"contains({n}, 'nation _5') OR contains({n}, 'nation_ 5')", "tax": f"contains({d}, '11222333') OR contains({d}, '44555666')",
             "postal": f"contains({d}, '87670')", "organ": Q.any_of(n, fixed.CANDIDACY_ORGANS), "kind": Q.any_of(n, fixed.CANDIDACY_TYPES), "money": f"regexp_matches({n}, 'r\\$\\s*[\\d.,]+')",
             "news": Q.any_of(n, fixed.CANDIDACY_NEWS)}
    found |= {f"near{i}": f"contains({n}, '{m}')" for i, m in enumerate(Q.NEIGHBOURS)} | {f"hall{i}": f"contains({n}, 'prefeitura municipal de {m}')" for i, m in enumerate(Q.NEIGHBOURS)}
    return ", ".join(f"({x}) AS {k}" for k, x in found.items())


_SIGNS = ["ours", "named", "weak", "tax", "postal", "organ", "kind", "money", "news", *[f"near{i}" for i in range(len(Q.NEIGHBOURS))], *[f"hall{i}" for i in range(len(Q.NEIGHBOURS))]]


def rated_sql() -> str:
    """(score, reasons) over the signs."""
    nb = "CASE " + " ".join(f"WHEN near{i} AND NOT ours THEN 'vizinho:{m}' WHEN hall{i} THEN 'prefeitura vizinha:{m}'" for i, m in enumerate(Q.NEIGHBOURS)) + " END"
    parts = [("named OR weak", "CASE WHEN named THEN 35 ELSE 20 END", "CASE WHEN named THEN 'menciona o alvo' ELSE 'possível alvo (leitura fraca)' END"), ("tax", "25", "'CNPJ do alvo'"), ("postal", "15", "'CEP do alvo'"),
             ("organ", "20", "'órgão oficial'"), ("kind", "12", "'tipo de ato'"), ("money", "5", "'valor monetário'"), (f"({nb}) IS NOT NULL", "-40", f"({nb})"), ("news AND NOT ours", "-15", "'possível matéria'")]
    score = "greatest(0, least(100, " + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p, _ in parts) + "))"
    reasons = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {r} END" for c, _, r in parts) + "], lambda r: r IS NOT NULL), '|')"
    return f"CAST({score} AS INTEGER) AS score, {reasons} AS reasons"


@query("H1_candidacy_score", f"""WITH x AS (SELECT edition_id, {Q.fold("title")} AS n FROM gz_editions UNION ALL SELECT edition_id, {Q.fold("text")} FROM gz_pages JOIN gz_editions USING (edition_id)),
g AS (SELECT edition_id, {', '.join(f'bool_or({c}) AS {c}' for c in _SIGNS)} FROM (SELECT edition_id, {signs_sql('n')} FROM x) GROUP BY 1),
s AS (SELECT edition_id, {rated_sql()} FROM g)
SELECT *, CAST(CASE WHEN score >= 55 THEN 0 WHEN score >= 25 THEN 1 ELSE 2 END AS INTEGER) AS priority FROM s""")
def _(t):
    return H.edition_candidacy(t.gz_editions, t.spread("gz_pages"), CONFIG).select("edition_id", "score", F.array_join("reasons", "|").alias("reasons"), "priority")


@query("H2_rescore_pending", f"""WITH x AS (SELECT edition_id, processed, candidacy, priority, {signs_sql(Q.fold("title || chr(10)"))} FROM gz_editions), s AS (SELECT edition_id, processed, candidacy, priority, {rated_sql()} FROM x)
SELECT edition_id, CASE WHEN processed = 0 THEN score ELSE candidacy END AS candidacy, CASE WHEN processed = 0 THEN CAST(CASE WHEN score >= 55 THEN 0 WHEN score >= 25 THEN 1 ELSE 2 END AS INTEGER) ELSE priority END AS priority FROM s""")
def _(t):
    return H.rescore_pending(t.gz_editions, CONFIG).select("edition_id", "candidacy", "priority")


_Q3 = "coalesce(priority, 1), coalesce(candidacy, 0) DESC, CASE WHEN coalesce(pub_date, '') = '' THEN 1 ELSE 0 END, pub_date DESC NULLS LAST, edition_id DESC"


@query("H3_pending_queue", f"SELECT edition_id, pub_date, priority, candidacy FROM gz_editions WHERE processed = 0 AND coalesce(failures, 0) < 3 ORDER BY {_Q3} LIMIT 100")
def _(t):
    return H.pending_queue(t.gz_editions, AS_OF_DAY, k=100).select("edition_id", "pub_date", "priority", "candidacy")


@query("H3_pending_queue_recent", "SELECT edition_id, pub_date FROM gz_editions WHERE processed = 0 AND (pub_date IS NULL OR pub_date >= CAST(DATE '2001-09-01' - 120 AS VARCHAR))")
def _(t):
    return H.pending_queue(t.gz_editions, AS_OF_DAY, recent_days=120, include_quarantine=True).select("edition_id", "pub_date")


@query("H4_agent_pick", f"""WITH p AS (SELECT * FROM gz_editions WHERE processed = 0 AND failures < 3)
SELECT edition_id, CAST(10 * coalesce(priority, 0) + coalesce(candidacy, 0) + CASE WHEN DATE '{AS_OF_DAY}' - CAST(pub_date AS DATE) <= 7 THEN 50 WHEN DATE '{AS_OF_DAY}' - CAST(pub_date AS DATE) <= 30 THEN 25 WHEN DATE '{AS_OF_DAY}' - CAST(pub_date AS DATE) <= 120 THEN 10 ELSE 0 END
  + CASE WHEN contains(lower(title), '{KEY}') THEN 40 ELSE 0 END + CASE WHEN file_path IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN file_path IS NOT NULL AND text_path IS NOT NULL THEN 5 ELSE 0 END AS INTEGER) AS pick_score FROM p
ORDER BY pick_score DESC, coalesce(priority, 1) DESC, coalesce(candidacy, 0) DESC, pub_date DESC NULLS LAST, edition_id DESC LIMIT 10""")
def _(t):
    return H.agent_pick(t.gz_editions, 10, AS_OF_DAY, CONFIG).select("edition_id", "pick_score")


ROWS_CTE = f"""rows AS (SELECT a.act_id, coalesce(e.pub_date, '') AS day, {Q.fold(" || ' ' || ".join(Q.txt(c) for c in ('a.act_type', 'a.number', 'a.organ', 'a.subject', 'a.summary', 'a.excerpt', 'a.value', 'e.title')))} AS b,
  CASE WHEN coalesce(a.summary, '') <> '' THEN 5 ELSE 0 END + CASE WHEN coalesce(a.value, '') <> '' THEN 2 ELSE 0 END AS boost FROM gz_acts a JOIN gz_editions e USING (edition_id))"""


@query("H5_rank_acts", f"""WITH {ROWS_CTE}, q AS (SELECT item_id AS query_id, tok, count(*) AS m FROM (SELECT item_id, unnest(regexp_extract_all({Q.fold('text')}, '[a-z0-9]{{2,}}')) AS tok FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, act_id, any_value(day) AS day, any_value(boost) + sum(CASE WHEN contains(b, tok) THEN m * (30 + 3 * CAST((length(b) - length(replace(b, tok, ''))) // length(tok) AS BIGINT)) ELSE 0 END) AS s FROM q, rows GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, act_id, round(s / 10.0, 2)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, day, act_id DESC) AS rank FROM s WHERE s > 0) WHERE rank <= 30""")
def _(t):
    acts = H.with_edition(t.spread("gz_acts"), t.gz_editions)
    return H.rank_acts_many(acts, t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 30)


@query("H5_rank_acts_one", f"""WITH {ROWS_CTE}, s AS (SELECT act_id, day, boost + {' + '.join(f"CASE WHEN contains(b, '{w}') THEN 30 + 3 * CAST((length(b) - length(replace(b, '{w}', ''))) // {len(w)} AS BIGINT) ELSE 0 END" for w in ('obra', 'de', 'asfalto', 'decreto', 'nation'))} AS s FROM rows)
SELECT act_id, round(s / 10.0, 2)::DOUBLE AS score FROM s WHERE s > 0 ORDER BY s DESC, day, act_id DESC LIMIT 50""")
def _(t):
    acts = H.with_edition(t.spread("gz_acts"), t.gz_editions)
    return H.rank_acts(acts, "Obra de asfalto, DECRETO nation", 50).select("act_id", "score")


@query("H6_filter_acts", f"""SELECT a.act_id, e.pub_date FROM gz_acts a JOIN gz_editions e USING (edition_id)
WHERE ({' OR '.join(f"contains(lower(coalesce({c}, '')), 'contrato')" for c in ('e.title', 'e.pub_date', 'a.organ', 'a.act_type', 'a.subject', 'a.summary', 'a.number'))}) AND e.pub_date >= '1996-01-01' AND e.pub_date <= '2000-12-31' AND contains(lower(coalesce(a.organ, '')), 'prefeitura') AND e.has_target = 1 AND lower(coalesce(a.confidence_level, '')) = 'revisar'""")
def _(t):
    return H.filter_acts(t.gz_acts, t.gz_editions, q="Contrato", since="1996-01-01", until="2000-12-31", organ="prefeitura", only_target=True, level="revisar", k=None).select("act_id", "pub_date")


@query("H6_filter_acts_month", "SELECT a.act_id, e.pub_date, e.title AS edition_title FROM gz_acts a JOIN gz_editions e USING (edition_id) WHERE e.pub_date LIKE '1998-03%' AND lower(coalesce(a.act_type, '')) = 'dispensa' ORDER BY e.pub_date DESC, a.act_id DESC")
def _(t):
    return H.filter_acts(t.gz_acts, t.gz_editions, month="1998-03", act_type="Dispensa").select("act_id", "pub_date", "edition_title")


@query("H7_global_search", """(SELECT 'edition' AS kind, edition_id AS id, title AS label FROM gz_editions WHERE processed = 1 AND (contains(lower(title), 'edital') OR contains(coalesce(pub_date, ''), 'edital')) ORDER BY pub_date DESC NULLS LAST, edition_id DESC LIMIT 5)
UNION ALL (SELECT 'act', act_id, concat_ws(' ', act_type, number, subject) FROM gz_acts WHERE contains(lower(coalesce(act_type, '')), 'edital') OR contains(lower(coalesce(organ, '')), 'edital') OR contains(lower(coalesce(subject, '')), 'edital') OR contains(lower(coalesce(number, '')), 'edital') ORDER BY act_id DESC LIMIT 10)""")
def _(t):
    return H.global_search(t.gz_acts, t.gz_editions, "edital")


# every act whose id is divisible by 100 asks, all acts answer
@query("H8_similar_acts", f"""WITH {ROWS_CTE}, q0 AS (SELECT act_id AS query_id, concat_ws(' ', nullif(act_type, ''), nullif(organ, ''), coalesce(nullif(subject, ''), nullif(summary, '')), nullif(themes, '')) AS x FROM gz_acts JOIN gz_editions e USING (edition_id) WHERE act_id % 100 = 0),
q AS (SELECT query_id, tok, count(*) AS m FROM (SELECT query_id, unnest(regexp_extract_all({Q.fold('x')}, '[a-z0-9]{{2,}}')) AS tok FROM q0) GROUP BY ALL),
s AS (SELECT query_id, act_id, any_value(day) AS day, any_value(boost) + sum(CASE WHEN contains(b, tok) THEN m * (30 + 3 * CAST((length(b) - length(replace(b, tok, ''))) // length(tok) AS BIGINT)) ELSE 0 END) AS s FROM q, rows WHERE act_id <> query_id GROUP BY ALL),
n AS (SELECT act_id, row_number() OVER (ORDER BY e.pub_date DESC NULLS LAST, act_id DESC) AS place FROM gz_acts JOIN gz_editions e USING (edition_id)),
none AS (SELECT query_id, n.act_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM q0, (SELECT * FROM n WHERE place <= 7) n WHERE n.act_id <> query_id AND query_id NOT IN (SELECT query_id FROM q))
SELECT query_id, CAST(rank AS INTEGER) AS rank, act_id, round(s / 10.0, 2)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, day, act_id DESC) AS rank FROM s WHERE s > 0) WHERE rank <= 6
UNION ALL SELECT query_id, CAST(rank AS INTEGER), act_id, NULL FROM none WHERE rank <= 6""")
def _(t):
    acts = H.with_edition(t.spread("gz_acts"), t.gz_editions)
    return H.similar_acts(acts, acts.where("act_id % 100 = 0"), 6)


_CH = Q.any_of(Q.fold(Q.txt("a.act_type")), fixed.CHAIN_TYPES)


@query("H9_act_timeline", f"""WITH n AS (SELECT act_id, edition_id, lower(trim(coalesce(number, ''))) AS num FROM gz_acts), c AS (SELECT act_id, edition_id, lower(coalesce(organ, '')) AS org FROM gz_acts a WHERE {_CH}),
r AS (SELECT g.act_id AS target_id, a.act_id, a.edition_id FROM n g JOIN n a ON g.num = a.num WHERE g.num <> '' AND a.act_id <> g.act_id
  UNION ALL SELECT g.act_id, c.act_id, c.edition_id FROM gz_acts g JOIN c ON contains(c.org, lower(coalesce(g.organ, '')[:40])) WHERE trim(coalesce(g.number, '')) = '' AND coalesce(g.act_type, '') <> '' AND c.act_id <> g.act_id)
SELECT target_id, act_id, edition_id, pub_date, CAST(rank AS INTEGER) AS rank FROM (SELECT r.*, e.pub_date, row_number() OVER (PARTITION BY target_id ORDER BY e.pub_date NULLS FIRST, act_id) AS rank FROM r JOIN gz_editions e USING (edition_id)) WHERE rank <= 12""")
def _(t):
    acts = t.spread("gz_acts")
    return H.act_timeline(acts, t.gz_editions, acts).select("target_id", "act_id", "edition_id", "pub_date", "rank")


@query("H10_latest_acts", "SELECT a.act_id, a.importance, e.pub_date FROM gz_acts a JOIN gz_editions e USING (edition_id) WHERE coalesce(a.importance, 0) >= 3 ORDER BY e.pub_date DESC NULLS LAST, a.act_id DESC LIMIT 15")
def _(t):
    return H.latest_acts(t.gz_acts, t.gz_editions, 15, min_importance=3).select("act_id", "importance", "pub_date")


@query("H11_month_mentions", "SELECT m.mention_id, m.page, m.term, e.pub_date, e.title FROM gz_mentions m JOIN gz_editions e USING (edition_id) WHERE e.pub_date LIKE '1999-05%'")
def _(t):
    return H.month_mentions(t.gz_mentions, t.gz_editions, "1999-05").select("mention_id", "page", "term", "pub_date", "title")


@query("H12_act_with_edition", """SELECT a.act_id, e.title AS edition_title, e.pub_date, e.url, (CASE WHEN starts_with(coalesce(validation, ''), '{') AND json_valid(validation) THEN validation ->> '$.ok' END) = 'true' AS validation_ok FROM gz_acts a JOIN gz_editions e USING (edition_id)""")
def _(t):
    return H.act_with_edition(t.gz_acts, t.gz_editions).select("act_id", "edition_title", "pub_date", "url", "validation_ok")


@query("H13_select_batch", """SELECT 'month' AS mode, edition_id, pub_date FROM gz_editions WHERE pub_date LIKE '1997-02%' UNION ALL SELECT 'days', edition_id, pub_date FROM gz_editions WHERE pub_date >= CAST(DATE '2001-09-01' - 30 AS VARCHAR)
UNION ALL (SELECT 'pending', edition_id, pub_date FROM gz_editions WHERE processed = 0 AND NOT contains(url, '/view') ORDER BY pub_date DESC NULLS LAST, edition_id DESC LIMIT 20)
UNION ALL SELECT 'cached', edition_id, pub_date FROM gz_editions e WHERE processed = 1 AND EXISTS (SELECT 1 FROM gz_files f WHERE replace(f.path, '.ocr.json', '.txt') = e.text_path)""")
def _(t):
    e = t.gz_editions
    files = t.gz_files.select(F.replace(F.col("path"), F.lit(".ocr.json"), F.lit(".txt")).alias("text_path"))
    parts = [("month", H.select_batch(e, AS_OF_DAY, month="1997-02")), ("days", H.select_batch(e, AS_OF_DAY, last_days=30)),
             ("pending", H.select_batch(e, AS_OF_DAY, pending_only=True, exclude_url="/view", k=20)), ("cached", H.select_batch(e, AS_OF_DAY, cached=files))]
    out = None
    for name, d in parts:
        d = d.select(F.lit(name).alias("mode"), "edition_id", "pub_date")
        out = d if out is None else out.unionByName(d)
    return out
