"""E-operators over the acts, with groups made large on purpose (one year is one scope, two pages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import linkage as E
from . import sqlx as Q
from .projections import AS_OF_TS, CONFIG
from .q_detect import family_sql, key_sql, organ_family_sql, preferred_sql, signature_sql, anchored_sql
from .registry import query

_SRC = """src AS (SELECT act_id, CAST(edition_id // 10000 AS BIGINT) AS year, CAST(act_id % 2 AS INTEGER) AS page, act_type, number, organ, subject, summary, excerpt, value, doc_date, importance, enriched FROM gz_acts)"""
_COLS = "act_id, year, page, act_type, number, organ, subject, summary, excerpt, value, doc_date, importance, enriched"


def _src(t):
    return t.spread("gz_acts").select(
        "act_id", F.floor(F.col("edition_id") / 10000).alias("year"), (F.col("act_id") % 2).cast("int").alias("page"), "act_type", "number", "organ",
        "subject", "summary", "excerpt", "value", "doc_date", "importance", "enriched")


@query("E1_families", f"SELECT act_id, {family_sql('act_type')} AS type_family, {organ_family_sql('organ')} AS organ_family FROM gz_acts")
def _(t):
    return t.gz_acts.select("act_id", E.type_family("act_type").alias("type_family"), E.organ_family("organ").alias("organ_family"))


_SIG = signature_sql("act_type", "subject", "summary", "excerpt", "NULL")


@query("E2_content_signature", f"SELECT act_id, {_SIG} AS signature FROM gz_acts")
def _(t):
    return t.gz_acts.select("act_id", E.content_signature("act_type", "subject", "summary", "excerpt", F.lit(None)).alias("signature"))


@query("E3_dedup_key", f"WITH s AS (SELECT *, {_SIG} AS sig FROM gz_acts) SELECT act_id, {key_sql('number', 'page', 'act_type', 'organ', 'sig', 'excerpt')} AS dedup FROM s")
def _(t):
    a = t.gz_acts
    return a.select("act_id", E.dedup_key(a).alias("dedup"))


def score_sql(organ: str = "organ") -> str:
    o = Q.fold(Q.txt(organ))
    return f"""(CASE WHEN {Q.filled('summary')} THEN 12.0 ELSE 0 END + CASE WHEN {Q.filled('value')} THEN 5 ELSE 0 END + CASE WHEN {Q.filled('subject')} THEN 2 ELSE 0 END + least(5, coalesce(importance, 0))
      + CASE WHEN contains({o}, 'prefeitura') THEN 4 WHEN contains({o}, 'municipio') THEN 2 WHEN contains({o}, 'camara') THEN 3 ELSE 0 END
      + CASE WHEN contains(coalesce(number, ''), '/') THEN 3 WHEN {Q.filled('number')} THEN 1 ELSE 0 END + least(length(coalesce(excerpt, '')), 800) / 200.0::DOUBLE + CASE WHEN enriched = 1 THEN 2 ELSE 0 END)::DOUBLE"""


@query("E4_act_quality", f"SELECT act_id, round({score_sql()}, 4) AS quality FROM gz_acts")
def _(t):
    a = t.gz_acts
    return a.select("act_id", F.round(E.act_quality(a), 4).alias("quality"))


_FILL = ("value", "summary", "subject", "doc_date")
_W = {"summary": 12.0, "value": 5.0, "subject": 2.0}


def _pick(a: str, b: str) -> str:
    gain = " + ".join(f"CASE WHEN coalesce({a}.{c}, '') = '' AND coalesce({b}.{c}, '') <> '' THEN {w} ELSE 0 END" for c, w in _W.items())
    fill = ", ".join(f"'{c}': CASE WHEN coalesce({a}.{c}, '') = '' AND coalesce({b}.{c}, '') <> '' THEN {b}.{c} ELSE {a}.{c} END" for c in _FILL)
    rest = ", ".join(f"'{c}': {a}.{c}" for c in ("page", "act_type", "number", "organ", "excerpt", "importance", "enriched"))
    return f"{{'act_id': acc.act_id, 's': ({a}.s + {gain})::DOUBLE, {fill}, {rest}}}"


@query("E5_dedup_acts", f"""WITH {_SRC}, n AS (SELECT * REPLACE ({Q.valid_number('number')} AS number) FROM src), g AS (SELECT *, {_SIG} AS sig FROM n),
k AS (SELECT *, {key_sql('number', 'page', 'act_type', 'organ', 'sig', 'excerpt')} AS dk, {score_sql()} AS s FROM g),
f AS (SELECT year, dk, list_reduce(list({{'act_id': act_id, 's': s, {', '.join(f"'{c}': {c}" for c in _FILL)}, 'page': page, 'act_type': act_type, 'number': number, 'organ': organ, 'excerpt': excerpt, 'importance': importance, 'enriched': enriched}} ORDER BY act_id),
  lambda acc, x: CASE WHEN x.s > acc.s THEN {_pick('x', 'acc')} ELSE {_pick('acc', 'x')} END) AS r FROM k GROUP BY ALL)
SELECT r.act_id AS act_id, year, r.page AS page, r.act_type AS act_type, r.number AS number, r.organ AS organ, r.subject AS subject, r.summary AS summary, r.excerpt AS excerpt, r.value AS value,
  r.doc_date AS doc_date, r.importance AS importance, r.enriched AS enriched FROM f""")
def _(t):
    return E.dedup_acts(_src(t), scope=("year",), order="act_id")


_STRONG = " OR ".join(f"list_contains(toks, {Q.lit(w)})" for w in fixed.STRONG_KEYWORDS)
_VOCAB = (*fixed.SIGNATURE_KEYWORDS, "25000", "104000", "255800")
_COMMON = " OR ".join(f"bool_and(CASE WHEN sig <> '' THEN list_contains(toks, {Q.lit(w)}) END)" for w in _VOCAB)


def _ff(c: str) -> str:
    return f"arg_min({c}, rk) FILTER (coalesce({c}, '') <> '')"


@query("E6_fuse_fragments", f"""WITH {_SRC}, s AS (SELECT *, {family_sql('act_type')} AS fam, {organ_family_sql('organ')} AS org, {score_sql()} AS sc, {_SIG} AS sig FROM src),
g AS (SELECT *, CASE WHEN fam IN ('termo_aditivo', 'contrato') THEN 'contrato_aditivo' ELSE fam END AS grp, string_split(sig, '|') AS toks FROM s),
c AS (SELECT *, row_number() OVER (PARTITION BY year, page, grp, org ORDER BY sc DESC, act_id) AS rk FROM g WHERE grp IN ({', '.join(Q.lit(x) for x in fixed.FUSED_GROUPS)})),
a AS (SELECT year, page, grp, org, count(*) AS n, count(*) FILTER (sig <> '') AS ns, coalesce({_COMMON}, false) AS common, bool_or(sig <> '' AND ({_STRONG})) AS strong, bool_or(length(coalesce(excerpt, '')) < 400) AS short,
  arg_min_null(act_id, rk) AS act_id, arg_min_null(act_type, rk) AS t0, arg_min(act_type, rk) FILTER (contains({Q.fold(Q.txt('act_type'))}, 'aditivo')) AS t1, arg_min_null(organ, rk) AS o0, arg_min(organ, rk) FILTER (contains({Q.fold(Q.txt('organ'))}, 'prefeitura')) AS o1,
  {_ff('number')} AS number, {_ff('value')} AS value, {_ff('subject')} AS subject, {_ff('doc_date')} AS doc_date, arg_min_null(importance, rk) AS importance, arg_min_null(enriched, rk) AS enriched,
  arg_max(excerpt, (length(coalesce(excerpt, '')), -rk)) AS excerpt, {_ff('summary')} AS s0, list(trim(summary) ORDER BY rk) FILTER (trim(coalesce(summary, '')) <> '') AS ss FROM c GROUP BY ALL),
f AS (SELECT * FROM a WHERE n > 1 AND ((ns >= 2 AND common) OR short OR (ns >= 2 AND strong))),
h AS (SELECT *, coalesce(t1, t0) AS act_type, CASE WHEN contains({Q.fold(Q.txt('o0'))}, 'prefeitura') THEN o0 ELSE coalesce(o1, o0) END AS organ,
  CASE WHEN len(ss) IS NULL OR len(ss) < 2 OR ss[1] = ss[2] THEN s0 WHEN contains(ss[1], ss[2][:80]) THEN ss[1] ELSE (ss[1] || ' ' || ss[2])[:800] END AS summary FROM f),
p AS (SELECT *, {Q.fold(Q.scan("coalesce(excerpt, '') || chr(10) || coalesce(summary, '')"))} AS ft, {Q.fold(Q.txt('act_type'))} AS kind FROM h),
v AS (SELECT *, {preferred_sql('ft', 'kind')} AS cand FROM p),
w AS (SELECT *, coalesce((SELECT n FROM (SELECT unnest(cand) AS n, generate_subscripts(cand, 1) AS i) ORDER BY (contains(kind, 'extrato') AND regexp_matches(ft, 'extrato\\s+(?:do\\s+|de\\s+)?contrato\\s+n[o°.]?\\s*' || string_split(n, '/')[1])) DESC,
   CASE WHEN contains(kind, 'extrato') AND regexp_matches(ft, 'extrato\\s+(?:do\\s+|de\\s+)?contrato\\s+n[o°.]?\\s*' || string_split(n, '/')[1]) THEN -i ELSE coalesce(try_cast(CASE WHEN contains(n, '/') THEN string_split(n, '/')[-1] END AS INTEGER), 0) END DESC, i LIMIT 1), NULL) AS pref,
   CASE WHEN {anchored_sql('number', "excerpt || chr(10) || coalesce(summary, '')")} THEN {Q.valid_number('number')} END AS rel FROM v)
SELECT {_COLS} FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.year = g.year AND f.page = g.page AND f.grp = g.grp AND f.org = g.org)
UNION ALL SELECT act_id, year, page, act_type, coalesce(rel, pref), organ, subject, summary, excerpt, value, doc_date, importance, enriched FROM w""")
def _(t):
    return E.fuse_fragments(_src(t), CONFIG, scope=("year",), order="act_id")


_NEW = """new AS (SELECT act_id + 1000000000 AS act_id, edition_id, page, CASE WHEN act_id % 7 = 0 THEN upper(act_type) ELSE act_type END AS act_type, CASE WHEN act_id % 3 = 0 THEN '777/' || number ELSE number END AS number,
  CASE WHEN act_id % 5 = 0 THEN 'x' || excerpt ELSE excerpt END AS excerpt FROM gz_acts)"""


def _new(t):
    i = F.col("act_id")
    return t.spread("gz_acts").select(
        (i + 1000000000).alias("act_id"), "edition_id", "page", F.when(i % 7 == 0, F.upper("act_type")).otherwise(F.col("act_type")).alias("act_type"),
        F.when(i % 3 == 0, F.concat(F.lit("777/"), "number")).otherwise(F.col("number")).alias("number"),
        F.when(i % 5 == 0, F.concat(F.lit("x"), "excerpt")).otherwise(F.col("excerpt")).alias("excerpt"),
        F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("feedback"), F.lit(None).cast("int").alias("attempts"), "organ")


def _keys_sql(x: str) -> str:
    p = f"CAST({x}.page AS VARCHAR) || '|' || trim({Q.fold(Q.txt(x + '.act_type'))})"
    n = f"trim({Q.fold(Q.txt(x + '.number'))})"
    h = f"substr(sha1(lower({x}.excerpt[:200])), 1, 12)"
    return f"{p} || '|' || {n} || '|' || {h} AS k1, {p} || '|' || {h} AS k2, {p} || '|' || {n} AS k3, substr(sha1(lower({x}.excerpt[:120])), 1, 12) AS k4"


def _first_free(i: int) -> str:
    """The first old act under key i that is still free."""
    return f"list_transform(list_filter(o.olds, lambda x: x.k{i} = n.k{i} AND NOT list_contains(r.used, x.id))[1:1], lambda x: {{'id': x.id, 'level': {i}}})[1]"


# act by act within each edition
@query("E7_merge_reprocessed", f"""WITH RECURSIVE {_NEW}, n AS (SELECT *, row_number() OVER (PARTITION BY edition_id ORDER BY id) AS i FROM (SELECT act_id AS id, edition_id, {_keys_sql('new')} FROM new)),
o AS (SELECT edition_id, list({{'id': id, 'k1': k1, 'k2': k2, 'k3': k3, 'k4': k4}} ORDER BY id) AS olds FROM (SELECT act_id AS id, edition_id, {_keys_sql('gz_acts')} FROM gz_acts) GROUP BY 1),
r AS (SELECT DISTINCT edition_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS nid, CAST(NULL AS BIGINT) AS oid, CAST(NULL AS INTEGER) AS level FROM n
  UNION ALL SELECT edition_id, i, CASE WHEN p IS NULL THEN used ELSE list_append(used, p.id) END, nid, p.id, p.level FROM (
    SELECT r.edition_id, n.i, r.used, n.id AS nid, coalesce({', '.join(_first_free(i) for i in (1, 2, 3, 4))}) AS p FROM r JOIN n ON n.edition_id = r.edition_id AND n.i = r.i + 1 JOIN o ON o.edition_id = r.edition_id) s),
m4 AS (SELECT nid, oid, level FROM r WHERE oid IS NOT NULL)
SELECT w.act_id, coalesce(nullif(w.number, ''), p.number) AS number, nullif(p.summary, '') AS summary, nullif(p.feedback, '') AS feedback, p.attempts, m.oid AS old_id, m.level
FROM new w LEFT JOIN m4 m ON m.nid = w.act_id LEFT JOIN gz_acts p ON p.act_id = m.oid""")
def _(t):
    out = E.merge_reprocessed(_new(t), t.spread("gz_acts"))
    return out.select("act_id", "number", "summary", "feedback", "attempts", "old_id", "level")


_K = "coalesce(act_type, '') || '|' || coalesce(number, '') || '|' || coalesce(organ, '')"


@query("E8_diff_acts", f"""WITH b AS (SELECT act_id, edition_id, {_K} AS k FROM gz_acts), a AS (SELECT act_id, edition_id, coalesce(act_type, '') || '|' || coalesce(CASE WHEN act_id % 3 = 0 THEN number || 'x' ELSE number END, '') || '|' || coalesce(organ, '') AS k FROM gz_acts WHERE act_id % 5 > 0)
SELECT act_id, edition_id, 'entered' AS change FROM a WHERE (edition_id, k) NOT IN (SELECT (edition_id, k) FROM b) UNION ALL SELECT act_id, edition_id, 'left' FROM b WHERE (edition_id, k) NOT IN (SELECT (edition_id, k) FROM a)""")
def _(t):
    cols = ["act_id", "edition_id", "act_type", "number", "organ"]
    before = t.gz_acts.select(*cols)
    after = before.where("act_id % 5 > 0").withColumn("number", F.when(F.col("act_id") % 3 == 0, F.concat("number", F.lit("x"))).otherwise(F.col("number")))
    return E.diff_acts(before, after).select("act_id", "edition_id", "change")


@query("E9_duplicate_groups", """SELECT trim(coalesce(act_type, '')) AS g_act_type, trim(number) AS g_number, trim(coalesce(organ, '')) AS g_organ, act_id, n, first_id FROM (
  SELECT *, count(*) OVER w AS n, min(act_id) OVER w AS first_id FROM gz_acts WHERE trim(coalesce(number, '')) <> '' WINDOW w AS (PARTITION BY trim(coalesce(act_type, '')), trim(number), trim(coalesce(organ, '')))) WHERE n > 1""")
def _(t):
    return E.duplicate_groups(t.gz_acts)


@query("E10_apply_updates", """
WITH u AS (SELECT act_id, CASE WHEN act_id % 3 = 0 THEN 'novo ' || act_id END AS summary, CASE WHEN act_id % 5 = 0 THEN 'Portaria' END AS act_type, CASE WHEN act_id % 11 = 0 THEN 5 END AS importance FROM gz_acts WHERE act_id % 2 = 0)
SELECT a.act_id, coalesce(u.summary, a.summary) AS summary, coalesce(u.act_type, a.act_type) AS act_type, coalesce(u.importance, a.importance) AS importance, a.feedback,
  CASE WHEN coalesce(u.summary, '') <> '' THEN 1 ELSE a.enriched END AS enriched, CASE WHEN u.act_id IS NULL THEN a.attempts ELSE a.attempts + 1 END AS attempts,
  CASE WHEN u.act_id IS NULL THEN a.enrich_status WHEN a.attempts + 1 >= 3 AND coalesce(u.summary, '') = '' AND trim(coalesce(a.summary, '')) = '' THEN 'esgotado' WHEN coalesce(u.summary, '') <> '' THEN 'ok' ELSE 'pendente' END AS enrich_status
FROM gz_acts a LEFT JOIN u ON a.act_id = u.act_id""")
def _(t):
    i = F.col("act_id")
    u = t.gz_acts.where("act_id % 2 = 0").select(
        "act_id", F.when(i % 3 == 0, F.concat(F.lit("novo "), i.cast("string"))).alias("summary"), F.when(i % 5 == 0, F.lit("Portaria")).alias("act_type"),
        F.when(i % 11 == 0, F.lit(5)).alias("importance"))
    return E.apply_updates(t.gz_acts, u, count_attempt=True).select("act_id", "summary", "act_type", "importance", "feedback", "enriched", "attempts", "enrich_status")


@query("E11_set_feedback", f"""SELECT a.act_id, CASE WHEN f.fb IN ('correto', 'errado', '') THEN nullif(f.fb, '') ELSE a.feedback END AS feedback,
  CASE WHEN f.fb IN ('correto', 'errado') THEN '{AS_OF_TS}' END AS feedback_at
FROM gz_acts a LEFT JOIN (SELECT doc_id AS act_id, CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'errado' ELSE 'correto' END ELSE CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'talvez' END END AS fb FROM labels) f ON a.act_id = f.act_id""")
def _(t):
    fb = t.labels.select(F.col("doc_id").alias("act_id"), F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, " Errado").otherwise("correto")).otherwise(
        F.when(F.col("doc_id") % 2 == 0, "").otherwise("talvez")).alias("feedback"))
    out = E.set_feedback(t.gz_acts, fb, F.lit(AS_OF_TS).cast("timestamp"))
    return out.select("act_id", "feedback", F.date_format("feedback_at", "yyyy-MM-dd HH:mm:ss").alias("feedback_at"))
