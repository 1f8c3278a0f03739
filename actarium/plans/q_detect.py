"""C- and D-operators: layout, mentions, extraction and the detection run."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import detection as D
from ..operators import extraction as X
from ..operators import layout as L
from . import sqlx as Q
from .projections import CONFIG
from .registry import query

KEY = "nation_5"
CRE = Q.lit

# ---- C1-C2 ---------------------------------------------------------------------------------


@query("C1_words_to_blocks", """
WITH w AS (SELECT *, trim(text) AS word, lft + x_offset AS x FROM gz_words WHERE trim(text) <> '' AND coalesce(try_cast(conf AS DOUBLE), -1) >= 0),
l AS (SELECT page, col, block_num, par_num, line_num, string_agg(word, ' ' ORDER BY pos) AS line, min(pos) AS p, min(x) AS l, min(top) AS t, max(x + width) AS r, max(top + height) AS b
  FROM w GROUP BY ALL)
SELECT page, CAST((col + 1) * 1000 + block_num AS INTEGER) AS block, string_agg(line, chr(10) ORDER BY line_num, p) AS text, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b
FROM l GROUP BY page, col, block_num""")
def _(t):
    return L.words_to_blocks(t.gz_words)


def organ_sql(x: str) -> str:
    """D8 over a scan-normalised text."""
    h, full, f = Q.fold(f"{Q.squeeze(x)}[:280]"), Q.fold(f"{Q.squeeze(x)}[:800]"), Q.fold(x)
    n = f"contains({f}, '{KEY}')"
    other = f"len(list_filter(regexp_extract_all({full}[:200], '\\bprefeitura\\s+(municipal\\s+)?de\\s+(\\w+)', 2), lambda w: NOT starts_with(w, '{KEY}'))) > 0"
    t = "NATION_5"
    return f"""(CASE WHEN regexp_matches({h}, '^\\s*(art\\.?\\s*\\d+|paragrafo|inciso)\\b') THEN NULL
      WHEN regexp_matches({h}, '^prefeitura( municipal)?( do municipio)? de {KEY}\\b') THEN 'Prefeitura Municipal de {t}'
      WHEN regexp_matches({h}, '^camara( municipal)? de {KEY}\\b') THEN 'Câmara Municipal de {t}'
      WHEN regexp_matches({h}, '^municipio de {KEY}\\b') THEN 'Município de {t}'
      WHEN regexp_matches({h}, '^prefeitura\\s+municipal\\s+de\\s+nat\\b') THEN 'Prefeitura Municipal de {t}'
      WHEN regexp_matches({h}, '^camara\\s+municipal\\s+de\\s+nat\\b') THEN 'Câmara Municipal de {t}'
      WHEN regexp_matches({full}, '\\bprefeitura\\s+(municipal\\s+)?de\\s+{KEY}\\b') AND NOT ({other}) THEN 'Prefeitura Municipal de {t}'
      WHEN regexp_matches({full}, '\\bmunicipio\\s+de\\s+{KEY}\\b') THEN 'Município de {t}'
      WHEN starts_with({h}, 'conselho municipal de saude') AND {n} THEN 'Conselho Municipal de Saúde de {t}'
      WHEN starts_with({h}, 'fundo municipal') AND {n} THEN 'Fundo Municipal de {t}'
      WHEN regexp_matches({h}, '^(conselho municipal|comite municipal|comissao municipal)\\b') AND {n} THEN 'Conselho Municipal de {t}'
      WHEN contains({x}, '11.222.333/0001-81') THEN 'Prefeitura Municipal de {t}'
      WHEN contains({x}, '44.555.666/0001') THEN CASE WHEN contains({f}, 'camara municipal') OR contains({f}, 'camara de {KEY}') THEN 'Câmara Municipal de {t}' ELSE 'Município de {t}' END END)"""


def lines_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda s: {Q.squeeze('s')}), lambda s: s <> '')"


def starts_sql(x: str) -> str:
    first = Q.fold(f"coalesce(({lines_sql(x)})[1], '')")
    return (f"(regexp_matches({first}, {CRE(fixed.TITLE_LINE)}) AND NOT (regexp_matches({first}, {CRE(fixed.LEGAL_REFERENCE)}) "
            f"AND NOT regexp_matches({first}, {CRE(fixed.LEGAL_REFERENCE_KEPT)})))")


@query("C2_group_blocks", f"""
WITH b AS (SELECT *, CASE WHEN block >= 1000 THEN block // 1000 ELSE 0 END AS col, ({organ_sql('n')} IS NOT NULL OR {starts_sql('text')}) AS starts
  FROM (SELECT *, {Q.scan('text')} AS n FROM gz_blocks WHERE trim(text) <> '')),
g AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER w AS grp, CASE WHEN NOT starts AND t - lag(b) OVER w > 420 THEN 1 ELSE 0 END AS far
  FROM b WINDOW w AS (PARTITION BY page, col ORDER BY t, block, seq)),
k AS (SELECT *, max(far) OVER (PARTITION BY page, col, grp ORDER BY t, block, seq) AS broken FROM g),
u AS (SELECT *, CASE WHEN grp > 0 AND broken = 0 THEN 'g' || grp ELSE 's' || seq END AS unit FROM k)
SELECT page, CAST(col AS INTEGER) AS "column", arg_min(block, (t, block, seq)) AS block, string_agg(text, chr(10) ORDER BY t, block, seq) AS text,
  min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM u GROUP BY page, col, unit""")
def _(t):
    return L.group_blocks(t.gz_blocks, CONFIG)


# ---- C3-C5 segments ------------------------------------------------------------------------


def offsets_sql(f: str, pattern: str) -> str:
    p = f"list_transform(string_split(regexp_replace({f}, {CRE(pattern)}, chr(1) || '\\0', 'g'), chr(1)), lambda q: length(q))"
    return f"list_transform(range(1, len({p})), lambda i: CAST(list_sum(({p})[1:i]) AS BIGINT))"


def spaced_sql(offs: str, gap: int) -> str:
    s = f"list_transform(list_sort(list_distinct({offs})), lambda o: [o])"
    return f"(CASE WHEN len({offs}) = 0 THEN []::BIGINT[] ELSE list_reduce({s}, lambda acc, y: CASE WHEN y[1] - acc[-1] >= {gap} THEN list_concat(acc, y) ELSE acc END) END)"


_ORG = r"prefeitura\s+municipal\s+de\s+{0}|prefeitura\s+de\s+{0}|camara\s+municipal\s+de\s+{0}|municipio\s+de\s+{0}"
_HEAD_LINE = r"(?m)^\s*(?:" + _ORG.format("nat(?:ion_5)?") + r")\b"
_HEAD = "(?:" + _ORG.format(KEY) + r"|prefeitura\s+municipal\s+de\s+nat\b|municipio\s+de\s+nat\b)"
_TAX = "(contains({d}, '112223') OR contains({d}, '445556'))"


def ours_sql(x: str) -> str:
    return f"(contains({Q.fold(x)}, '{KEY}') OR {_TAX.replace('{d}', Q.digits(x))})"


SPLIT_CTE = f"""
sp0 AS (SELECT edition_id, page, method, text, {Q.fold('text')} AS f FROM gz_pages),
sp1 AS (SELECT *, CASE WHEN length(text) < 900 THEN []::BIGINT[] ELSE list_concat(list_filter({offsets_sql('f', _HEAD_LINE)}, lambda o: o > 40),
  list_filter({offsets_sql('f', '(?m)^(' + fixed.TITLE_MID_LINE + ')')}, lambda o: o > 80)) END AS raw FROM sp0),
sp2 AS (SELECT *, {spaced_sql('raw', 120)} AS cuts FROM sp1),
sp3 AS (SELECT *, list_filter(list_transform(range(1, len(cuts) + 2), lambda i: {{'block': CAST(100 + i AS INTEGER), 'text': {Q.strip("substr(text, CAST(([0] || cuts)[i] AS BIGINT) + 1, (cuts || [length(text)])[i] - ([0] || cuts)[i])")}}}),
  lambda s: length(s.text) >= 40) AS pcs FROM sp2),
base AS (SELECT edition_id, page, method, unnest(CASE WHEN len(cuts) = 0 OR len(pcs) = 0 THEN [{{'block': CAST(1 AS INTEGER), 'text': text}}] ELSE pcs END) AS s,
  generate_subscripts(CASE WHEN len(cuts) = 0 OR len(pcs) = 0 THEN [{{'block': CAST(1 AS INTEGER), 'text': text}}] ELSE pcs END, 1) AS n FROM sp3)"""

_WIN = "substr(t, greatest(p.o - 450, 0) + 1, p.o + p.n + 500 - greatest(p.o - 450, 0))"
FALL_CTE = f"""
fb0 AS (SELECT edition_id, page, method, {Q.scan('text')} AS t FROM gz_pages WHERE length({Q.strip('text')}) >= 100),
fb1 AS (SELECT *, {Q.fold('t')} AS f FROM fb0 WHERE {ours_sql('t')}),
fb2 AS (SELECT *, {offsets_sql('f', _HEAD)} AS heads, {offsets_sql('f', fixed.TITLE_TYPE_NUMBER)} AS os, regexp_extract_all(f, {CRE(fixed.TITLE_TYPE_NUMBER)}) AS ms FROM fb1),
fb3 AS (SELECT *, list_transform(list_filter(list_transform(range(1, len(ms) + 1), lambda i: {{'o': os[i], 'n': length(ms[i])}}), lambda p: {ours_sql(_WIN)}),
  lambda p: p.o - length(string_split(t[:p.o], chr(10))[-1])) AS ls FROM fb2),
fb4 AS (SELECT *, {spaced_sql('list_concat(heads, ls)', 100)} AS st FROM fb3),
fb5 AS (SELECT *, list_transform(range(1, len(st) + 1), lambda i: CASE WHEN i < len(st) THEN st[i + 1] ELSE least(length(t), st[i] + CASE WHEN length(t) - st[i] < 60 THEN 800 ELSE 2200 END) END) AS en FROM fb4),
fb6 AS (SELECT edition_id, page, method, CASE WHEN len(st) = 0 THEN CASE WHEN {Q.any_of('f', fixed.OFFICIAL_SIGNALS)} THEN [{{'block': CAST(9000 AS INTEGER), 'text': t}}] ELSE [] END
  ELSE list_transform(list_filter(list_transform(range(1, len(st) + 1), lambda i: {{'block': CAST(9099 + i AS INTEGER), 'text': {Q.strip('substr(t, st[i] + 1, en[i] - st[i])')}}}),
    lambda s: length(s.text) >= 50 AND {ours_sql('s.text')}), lambda s: {{'block': s.block, 'text': s.text}}) END AS ws FROM fb5),
fall AS (SELECT edition_id, page, method, unnest(ws) AS s, generate_subscripts(ws, 1) AS n FROM fb6)"""

SEG_CTE = f"""{SPLIT_CTE},{FALL_CTE},
fkey AS (SELECT *, {Q.fold('s.text[:120]')} AS k, row_number() OVER (PARTITION BY edition_id, page, {Q.fold('s.text[:120]')} ORDER BY n) AS kn FROM fall),
fnew AS (SELECT f.* FROM fkey f WHERE kn = 1 AND k <> '' AND NOT EXISTS (SELECT 1 FROM base b WHERE b.edition_id = f.edition_id AND b.page = f.page AND {Q.fold('b.s.text[:120]')} = f.k)),
segs AS (SELECT edition_id, page, method, CAST(row_number() OVER (PARTITION BY edition_id, page ORDER BY src, n) - 1 AS INTEGER) AS seg_no, s.block AS block, s.text AS text FROM (
  SELECT 0 AS src, n, edition_id, page, method, s FROM base UNION ALL SELECT 1, n, edition_id, page, method, s FROM fnew))"""


@query("C3_split_multi_act", f"WITH {SPLIT_CTE} SELECT edition_id, page, s.block AS block, s.text AS text FROM base")
def _(t):
    s = L.split_multi_act(F.col("text"), F.lit(1), CONFIG)
    return t.spread("gz_pages").select("edition_id", "page", F.explode_outer(s).alias("s")).select("edition_id", "page", "s.block", "s.text")


@query("C4_fallback_windows", f"WITH {FALL_CTE} SELECT edition_id, page, s.block AS block, s.text AS text FROM fall")
def _(t):
    s = L.fallback_windows(F.col("text"), CONFIG)
    return t.spread("gz_pages").select("edition_id", "page", F.explode_outer(s).alias("s")).where("s is not null").select("edition_id", "page", "s.block", "s.text")


@query("C5_page_segments", f"WITH {SEG_CTE} SELECT edition_id, page, seg_no, block, text FROM segs")
def _(t):
    return L.page_segments(t.spread("gz_pages"), CONFIG).drop("method")


@query("C6_weak_pages", f"""SELECT edition_id, page, (length({Q.strip('text')}) < 100 OR (contains(lower(method), 'ocr') AND NOT contains(lower(method), 'pdfplumber'))) AS weak FROM gz_pages""")
def _(t):
    return t.spread("gz_pages").select("edition_id", "page", L.is_weak_page("text", "method", CONFIG).alias("weak"))


@query("C7_candidate_pages", f"""SELECT edition_id, page, method FROM gz_pages WHERE method NOT IN ('ocr', 'ocr-hq', 'ocr-hq-string')
  AND {Q.any_of(Q.fold('text'), (KEY, '11.222.333/0001-81', 'prefeitura municipal', 'camara municipal', 'municipio'))}""")
def _(t):
    return L.candidate_pages(t.spread("gz_pages"), CONFIG).select("edition_id", "page", "method")


_VARIANTS = """variants AS (SELECT edition_id, page % 400 AS page, CAST(page // 400 AS INTEGER) AS strategy_no, method, text FROM gz_pages)"""


def _variants(t):
    return t.spread("gz_pages").select("edition_id", (F.col("page") % 400).alias("page"), F.floor(F.col("page") / 400).cast("int").alias("strategy_no"), "method", "text")


@query("C8_best_extraction", f"""WITH {_VARIANTS} SELECT edition_id, page, strategy_no, method, text FROM (
  SELECT *, row_number() OVER (PARTITION BY edition_id, page ORDER BY CASE WHEN length({Q.strip('text')}) >= 300 THEN 0 ELSE 1 END,
    CASE WHEN length({Q.strip('text')}) >= 300 THEN strategy_no ELSE -length(text) END, strategy_no) AS rn FROM variants) WHERE rn = 1""")
def _(t):
    return L.best_extraction(_variants(t), CONFIG)


@query("C9_merge_pages", """SELECT n.edition_id, n.page, coalesce(r.text, n.text) AS text, coalesce(r.method, n.method) AS method
FROM gz_pages n LEFT JOIN (SELECT edition_id, page, 'structured: ' || text AS text, 'ocr' AS method FROM gz_pages WHERE method = 'pdfplumber') r ON n.edition_id = r.edition_id AND n.page = r.page""")
def _(t):
    re_read = t.gz_pages.where("method = 'pdfplumber'").select(
        "edition_id", "page", F.concat(F.lit("structured: "), "text").alias("text"), F.lit("ocr").alias("method"))
    return L.merge_pages(t.gz_pages, re_read)


# ---- D1-D6 mentions ------------------------------------------------------------------------

LEX = (("prefeitura municipal de nation_5", "Prefeitura Municipal de NATION_5"), ("camara municipal de nation_5", "Câmara Municipal de NATION_5"),
       ("prefeitura de nation_5", "Prefeitura de NATION_5"), ("municipio de nation_5", "Município de NATION_5"),
       ("11.222.333/0001-81", "11.222.333/0001-81"), ("44.555.666/0001-77", "44.555.666/0001-77"), ("camara de nation_5", "Câmara de NATION_5"), ("nation_5", "NATION_5"))


@query("D1_build_lexicon", "SELECT t.i AS term_no, t.f AS folded, t.l AS label, count(o.k) AS n_acts FROM (VALUES " + ", ".join(
    f"(CAST({i} AS INTEGER), {CRE(a)}, {CRE(b)})" for i, (a, b) in enumerate(LEX)) + f""") t(i, f, l)
  LEFT JOIN (SELECT act_id AS k, {Q.fold("coalesce(organ, '') || ' ' || excerpt")} AS x FROM gz_acts) o ON contains(o.x, t.f) GROUP BY ALL""")
def _(t):
    from ..functions.text import fold, text
    x = fold(F.concat(text("organ"), F.lit(" "), F.col("excerpt")))
    hit = t.spread("gz_acts").select(F.explode(F.filter(F.array(*[F.struct(F.lit(f).alias("folded"), F.contains(x, F.lit(f)).alias("has")) for f, _ in CONFIG.lexicon]),
                                              lambda s: s["has"])).alias("s")).groupBy(F.col("s.folded").alias("folded")).agg(F.count("*").alias("n"))
    lex = D.build_lexicon(t.spark, CONFIG)
    return lex.join(hit, "folded", "left").select("term_no", "folded", "label", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_acts"))


def ctx_sql(t: str, o: str, e: str, m: int) -> str:
    return f"substr({t}, greatest(0, {o} - {m}) + 1, {e} + {m} - greatest(0, {o} - {m}))"


def sponsor_sql(t: str, o: str, e: str) -> str:
    c = Q.fold(ctx_sql(t, o, e, 180))
    words = ["distribuicao avulsa", "distribuicao avulsa", "auto posto", "panificadora", "farmacia", "farmacia", "loterias", "patrocinadores", "anunciante", "anunciantes"]
    return f"(contains({c}, 'distribuicao avulsa') OR ({' + '.join(f'contains({c}, {CRE(w)})::INT' for w in words)}) >= 2)"


def mentions_cte(src: str) -> str:
    """CTEs up to ``men``: all mentions of the (edition_id, page, seg_no, block, text) rows of ``src``."""
    parts = []
    for no, (term, label) in enumerate(LEX):
        n = len(term)
        lens = f"list_transform(string_split(f, {CRE(term)}), lambda q: length(q))"
        offs = f"list_transform(range(1, len({lens})), lambda i: CAST(list_sum(({lens})[1:i]) + (i - 1) * {n} AS BIGINT))"
        cond = ""
        if term == KEY:
            near, wide = Q.fold(ctx_sql("t", "o", f"o + {n}", 50)), Q.fold(ctx_sql("t", "o", f"o + {n}", 200))
            cond = f"""WHERE NOT {sponsor_sql('t', 'o', f'o + {n}')} AND NOT regexp_matches(CASE WHEN o > 0 THEN t[o:o] ELSE ' ' END, '\\p{{L}}') AND NOT regexp_matches(t[o + {n + 1}:o + {n + 1}], '\\p{{L}}')
              AND NOT ((regexp_matches({near}, '\\bmarca\\s*[:\\-]?\\s*{KEY}\\b') OR regexp_matches({near}, '\\b{KEY}\\s*\\d+\\b')) AND NOT {Q.any_of(wide, ('prefeitura', 'municipio de ' + KEY, 'camara municipal', 'cnpj'))})"""
        parts.append(f"SELECT edition_id, page, seg_no, block, CAST({no} AS INTEGER) AS term_no, o AS start, o + {n} AS stop, {CRE(label)} AS label, t FROM (SELECT *, unnest({offs}) AS o FROM mt WHERE contains(f, {CRE(term)})) {cond}")
    pat = r"\b(?:87)\.?\d{3}-\d{3}\b"
    parts.append(f"""SELECT edition_id, page, seg_no, block, CAST({len(LEX)} AS INTEGER), o, o + length(c), 'CEP ' || replace(c, '.', ''), t FROM (
      SELECT *, unnest({offsets_sql('t', pat)}) AS o, unnest(regexp_extract_all(t, {CRE(pat)})) AS c FROM mt) WHERE starts_with(replace(replace(c, '.', ''), '-', ''), '87670') AND NOT {sponsor_sql('t', 'o', 'o + length(c)')}""")
    return f"""mt AS (SELECT edition_id, page, seg_no, block, t, {Q.fold('t')} AS f FROM (SELECT edition_id, page, seg_no, block, {Q.scan('text')} AS t FROM {src})),
men AS (SELECT edition_id, page, seg_no, block, term_no, CAST(start AS INTEGER) AS start, label, '...' || {Q.squeeze(ctx_sql('t', 'start', 'stop', 120))} || '...' AS excerpt FROM ({' UNION ALL '.join(parts)}))"""


_WHOLE = "whole AS (SELECT edition_id, page, CAST(0 AS INTEGER) AS seg_no, CAST(1 AS INTEGER) AS block, text FROM gz_pages)"
_MCOLS = "edition_id, page, seg_no, block, term_no, start, label, excerpt"


def _whole(t):
    return t.spread("gz_pages").select("edition_id", "page", F.lit(0).alias("seg_no"), F.lit(1).alias("block"), "text")


@query("D2_find_mentions", f"WITH {_WHOLE}, {mentions_cte('whole')} SELECT {_MCOLS} FROM men WHERE term_no < {len(LEX)}")
def _(t):
    return D.find_mentions(_whole(t), CONFIG).where(F.col("term_no") < len(CONFIG.lexicon))


@query("D3_find_postal_mentions", f"WITH {_WHOLE}, {mentions_cte('whole')} SELECT {_MCOLS} FROM men WHERE term_no = {len(LEX)}")
def _(t):
    return D.find_mentions(_whole(t), CONFIG).where(F.col("term_no") == len(CONFIG.lexicon))


@query("D4_mention_filters", f"""
SELECT edition_id, page, {sponsor_sql('text', 'o', 'o + 8')} AS sponsor,
  (regexp_matches(CASE WHEN o > 0 THEN text[o:o] ELSE ' ' END, '\\p{{L}}') OR regexp_matches(text[o + 9:o + 9], '\\p{{L}}')) AS glued,
  ((regexp_matches({Q.fold(ctx_sql('text', 'o', 'o + 8', 50))}, '\\bmarca\\s*[:\\-]?\\s*{KEY}\\b') OR regexp_matches({Q.fold(ctx_sql('text', 'o', 'o + 8', 50))}, '\\b{KEY}\\s*\\d+\\b'))
    AND NOT {Q.any_of(Q.fold(ctx_sql('text', 'o', 'o + 8', 200)), ('prefeitura', 'municipio de ' + KEY, 'camara municipal', 'cnpj'))}) AS brand
FROM (SELECT *, instr({Q.fold('text')}, '{KEY}') - 1 AS o FROM gz_pages) WHERE o >= 0""")
def _(t):
    from ..functions.text import fold
    p = t.spread("gz_pages").withColumn("o", F.instr(fold("text"), KEY) - 1).where("o >= 0")
    x, o = F.col("text"), F.col("o")
    return p.select("edition_id", "page", X.sponsor_context(x, o, o + 8, CONFIG).alias("sponsor"), X.glued_mention(x, o, o + 8).alias("glued"),
                    X.brand_context(x, o, o + 8, CONFIG).alias("brand"))


def spec_sql(label: str) -> str:
    f = Q.fold(label)
    return f"""CASE WHEN contains({f}, 'prefeitura municipal') THEN 100 WHEN contains({f}, 'camara municipal') THEN 95 WHEN contains({f}, 'municipio de') THEN 85
      WHEN contains({f}, 'prefeitura de') THEN 80 WHEN contains({f}, 'camara de') THEN 75 WHEN contains({f}, 'joao silva') THEN 70
      WHEN regexp_matches({f}, '\\d{{2}}\\.\\d{{3}}\\.\\d{{3}}') OR contains({f}, 'cnpj') THEN 65 WHEN starts_with({f}, 'cep') THEN 50 WHEN {f} = '{KEY}' THEN 10 ELSE 40 END"""


MKEY = f"substr(trim(regexp_replace({Q.fold('excerpt')}, '\\s+', ' ', 'g')), 1, 160)"
DEDUP_MEN = f"""dmen AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY edition_id, page, {MKEY} ORDER BY {spec_sql('label')} DESC, seg_no, term_no, start) AS rn FROM men) WHERE rn = 1)"""


@query("D5_dedup_mentions", f"WITH {_WHOLE}, {mentions_cte('whole')}, {DEDUP_MEN} SELECT {_MCOLS} FROM dmen")
def _(t):
    return D.dedup_mentions(D.find_mentions(_whole(t), CONFIG), CONFIG)


_HASH = f"md5(CAST(page AS VARCHAR) || '|' || {Q.squeeze('excerpt')})"


@query("D6_upsert_mentions", f"""
WITH old AS (SELECT edition_id, page, excerpt, term, notified, {_HASH} AS hash FROM gz_mentions WHERE edition_id % 2 = 0 OR notified = 1),
new AS (SELECT edition_id, page, excerpt, term, {_HASH} AS hash FROM gz_mentions WHERE edition_id % 2 = 1 OR edition_id % 3 = 0),
kept AS (SELECT * FROM old WHERE notified = 1 OR edition_id NOT IN (SELECT edition_id FROM new)),
one AS (SELECT edition_id, hash, min((page, excerpt, term)) AS r FROM new GROUP BY ALL)
SELECT edition_id, page, excerpt, term, notified, hash FROM kept
UNION ALL SELECT edition_id, r[1], r[2], r[3], CAST(0 AS INTEGER), hash FROM one o WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.edition_id = o.edition_id AND k.hash = o.hash)""")
def _(t):
    m = t.gz_mentions.drop("mention_id")
    old = m.where("edition_id % 2 = 0 OR notified = 1")
    new = m.where("edition_id % 2 = 1 OR edition_id % 3 = 0").drop("notified")
    return D.upsert_mentions(old, new)


# ---- D7-D16 extraction ---------------------------------------------------------------------


def category_sql(x: str) -> str:
    return (f"(CASE WHEN {sponsor_sql(x, '0', f'least(length({x}), 1)')} THEN 'patrocinador_distribuicao' WHEN {Q.any_of(Q.fold(x), fixed.OFFICIAL_SIGNALS)} "
            f"THEN 'publicacao_oficial' ELSE 'materia_jornalistica' END)")


@query("D7_classify_category", f"SELECT edition_id, page, {category_sql('text')} AS category FROM gz_pages")
def _(t):
    return t.spread("gz_pages").select("edition_id", "page", X.category("text", CONFIG).alias("category"))


@query("D8_extract_organ", f"SELECT edition_id, page, {organ_sql('n')} AS organ FROM (SELECT *, {Q.scan('text')} AS n FROM gz_pages)")
def _(t):
    return t.spread("gz_pages").select("edition_id", "page", X.extract_organ("text", CONFIG).alias("organ"))


def _m(p: str, x: str = "f") -> str:
    return f"regexp_matches({x}, {CRE(p)})"


def type_cte(src: str, keys: str, x: str = "n") -> str:
    """CTEs up to ``ty``: (keys, act_type, number) of the scan-normalised text column ``x`` of ``src``."""
    g = {i: f"regexp_extract(f, {CRE(fixed.TITLE_TYPE_NUMBER)}, {i})" for i in (0, 1, 2)}
    personal = f"""(CASE WHEN regexp_matches(line, {CRE(fixed.PERSONAL_ID)}) THEN true WHEN regexp_matches(f, 'n[o°.]?\\s*' || replace(num, '.', '[.]')) THEN false
      WHEN contains(num, '.') AND NOT contains(num, '/') THEN true ELSE {Q.any_of('f', ('cpf', 'rg', 'cnpj'))} END)"""
    glued = "(CASE WHEN regexp_full_match(nn, '\\d{6,8}') THEN CASE WHEN regexp_matches(right(nn, 4), '^(19|20)') THEN nn[:-5] || '/' || right(nn, 4) ELSE '' END ELSE nn END)"
    return f"""ty0 AS (SELECT {keys}, {lines_sql(x)} AS ls FROM {src}),
ty1 AS (SELECT {keys}, unnest(CASE WHEN len(ls) > 0 THEN list_append(ls, array_to_string(ls[1:3], ' ')) ELSE ls END) AS line, generate_subscripts(CASE WHEN len(ls) > 0 THEN list_append(ls, 'x') ELSE ls END, 1) AS i FROM ty0),
ty2 AS (SELECT *, {Q.fold('line')} AS f FROM ty1),
ty3 AS (SELECT *, {g[0]} AS m0, {g[1]} AS m1, nullif({g[2]}, '') AS num, {_m(fixed.TITLE_LINE)} AS title, {_m(fixed.TYPE_WITH_MARK)} AS marked, {_m(fixed.LEGAL_REFERENCE)} AS legal, contains(f, 'n') AS nn FROM ty2),
ty4 AS (SELECT * FROM ty3 WHERE m1 <> '' AND NOT (legal AND NOT title AND NOT marked) AND NOT (NOT title AND NOT marked AND NOT {_m(fixed.ACT_HINT)})
  AND NOT (m1 = 'lei' AND (legal OR NOT nn)) AND NOT (legal AND NOT nn AND NOT (contains(m1, 'aditivo') OR contains(m1, 'extrato') OR contains(m1, 'dispensa')))),
ty5 AS (SELECT * EXCLUDE (nn), CASE WHEN num IS NULL OR {personal} THEN NULL ELSE regexp_replace(trim(num), '^[.,;:]+|[.,;:]+$', '', 'g') END AS nn,
  {Q.squeeze("substr(line, instr(f, m0) + instr(m0, m1) - 1, length(m1))")} AS raw FROM ty4),
ty AS (SELECT {keys}, CASE WHEN contains(m1, 'termo') AND contains(m1, 'aditivo') THEN 'Termo Aditivo' WHEN contains(m1, 'extrato') AND contains(m1, 'contrato') THEN 'Extrato de Contrato'
  WHEN contains(m1, 'dispensa') THEN 'Dispensa' WHEN contains(m1, 'homolog') THEN 'Homologação/Adjudicação' WHEN contains(m1, 'pregao') THEN 'Pregão' ELSE {Q.title('raw')} END AS act_type,
  CASE WHEN nn IS NOT NULL THEN {glued} END AS number FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY i) AS rn FROM ty5) WHERE rn = 1)"""


_NORM = f"np AS (SELECT edition_id, page, method, {Q.scan('text')} AS n FROM gz_pages)"


@query("D9_extract_type_number", f"WITH {_NORM}, {type_cte('np', 'edition_id, page')} SELECT np.edition_id, np.page, ty.act_type, ty.number FROM np LEFT JOIN ty USING (edition_id, page)")
def _(t):
    s = t.spread("gz_pages").select("edition_id", "page", X.extract_type_number("text", CONFIG).alias("x"))
    return s.select("edition_id", "page", "x.act_type", "x.number")


def anchored_sql(n: str, x: str) -> str:
    v = Q.fold(f"coalesce({Q.valid_number(n)}, {Q.strip(Q.txt(n))})")
    q = f"regexp_replace(regexp_replace({v}, '([^a-z0-9/])', '\\\\\\1', 'g'), '/', '\\\\s*[/\\\\-.]\\\\s*', 'g')"
    return f"({v} <> '' AND {Q.txt(x)} <> '' AND regexp_matches({Q.fold(Q.txt(x))}, '(?:n[o°.]?\\s*|numero\\s*[:\\s]*)' || {q} || '\\b'))"


@query("D10_number_anchored", f"""SELECT act_id, {anchored_sql('number', 'excerpt')} AS anchored,
  CASE WHEN {Q.strip("coalesce(excerpt, '') || coalesce(summary, '')")} = '' THEN {Q.valid_number('number')} WHEN {anchored_sql('number', "excerpt || chr(10) || coalesce(summary, '')")} THEN {Q.valid_number('number')} END AS reliable FROM gz_acts""")
def _(t):
    return t.spread("gz_acts").select("act_id", X.number_anchored("number", "excerpt").alias("anchored"), X.reliable_number("number", "excerpt", "summary").alias("reliable"))


def preferred_sql(f: str, kind: str) -> str:
    ex = [f"regexp_extract_all({f}, {CRE(p)}, 1)" for p in fixed.TYPED_NUMBERS]
    rest = ", ".join(ex)
    cands = f"flatten([CASE WHEN contains({kind}, 'aditivo') AND NOT contains({kind}, 'extrato') THEN list_concat({ex[2]}, {ex[1]}) ELSE [] END, {rest}, regexp_extract_all({f}, {CRE(fixed.GENERIC_NUMBER)}, 1)])"
    vals = f"list_filter(list_transform({cands}, lambda s: {Q.valid_number(chr(114) + 'eplace(s, ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + chr(39) + ')')}), lambda s: s IS NOT NULL)"
    return vals


@query("D11_preferred_number", f"""
WITH p AS (SELECT edition_id, page, f, CASE page % 3 WHEN 0 THEN 'extrato de contrato' WHEN 1 THEN 'termo aditivo' ELSE '' END AS kind FROM (SELECT *, {Q.fold(Q.scan('text'))} AS f FROM gz_pages)),
c AS (SELECT *, {preferred_sql('f', 'kind')} AS v FROM p),
u AS (SELECT edition_id, page, f, kind, unnest(v) AS n, generate_subscripts(v, 1) AS i FROM c),
s AS (SELECT *, coalesce(try_cast(CASE WHEN contains(n, '/') THEN string_split(n, '/')[-1] END AS INTEGER), 0) AS y, kind LIKE '%extrato%' AND regexp_matches(f, 'extrato\\s+(?:do\\s+|de\\s+)?contrato\\s+n[o°.]?\\s*' || string_split(n, '/')[1]) AS own FROM u),
b AS (SELECT edition_id, page, n, row_number() OVER (PARTITION BY edition_id, page ORDER BY own DESC, CASE WHEN own THEN -i ELSE y END DESC, i) AS rn FROM s)
SELECT p.edition_id, p.page, b.n AS number FROM p LEFT JOIN b ON p.edition_id = b.edition_id AND p.page = b.page AND b.rn = 1""")
def _(t):
    kind = F.when(F.col("page") % 3 == 0, "Extrato de Contrato").when(F.col("page") % 3 == 1, "Termo Aditivo").otherwise("")
    return t.spread("gz_pages").select("edition_id", "page", X.preferred_number("text", kind, CONFIG).alias("number"))


def date_sql(n: str) -> str:
    return Q.squeeze(f"coalesce(nullif(regexp_extract({n}, {CRE(fixed.DATE_LONG)}), ''), nullif(regexp_extract({n}, {CRE(fixed.DATE_NUMERIC)}), ''))")


@query("D12_extract_date", f"WITH {_NORM} SELECT edition_id, page, {date_sql('n')} AS doc_date FROM np")
def _(t):
    return t.spread("gz_pages").select("edition_id", "page", X.extract_date("text", CONFIG).alias("doc_date"))


_FOOT = fixed.FOOTER_LINE.replace("|assinado", "|joao silva|assinado")


def footer_sql(s: str) -> str:
    return f"regexp_matches({Q.fold(f'{Q.squeeze(s)}[:160]')}, {CRE(_FOOT)})"


def subject_sql(ls: str) -> str:
    """D13 over a list of lines."""
    lab = CRE(fixed.SUBJECT_LABEL_RAW)

    def labelled(s: str) -> str:
        return f"({Q.title(f'regexp_extract({s}, {lab}, 1)')} || ': ' || trim(regexp_extract({s}, {lab}, 2)))"

    def first(cond: str, lst: str) -> str:
        return f"list_filter({lst}, lambda s: {cond})[1]"

    title = f"regexp_matches({Q.fold('s')}, {CRE(fixed.TITLE_LINE)})"
    at = f"coalesce(list_position(list_transform({ls}, lambda s: {title}), true), 0)"
    nxt = f"{ls}[{at} + 1:{at} + 4]"
    has = f"regexp_matches(s, {lab})"
    ln = first(has, nxt)
    after = f"""(CASE WHEN regexp_matches({ls}[{at}], {lab}) THEN {labelled(f'{ls}[{at}]')} WHEN {ln} IS NOT NULL THEN {ls}[{at}] || ' - ' || trim(regexp_extract({ln}, {lab}, 2))
      ELSE coalesce({first(f'NOT {footer_sql("s")} AND NOT {title}', nxt)}, {ls}[{at}]) END)"""
    kw = Q.any_of(Q.fold("s"), fixed.SUBJECT_KEYWORDS)
    other = f"coalesce(CASE WHEN {first(has, ls)} IS NOT NULL THEN {labelled(first(has, ls))} END, {first(kw, ls)}, {first(f'NOT {footer_sql(chr(115))}', ls)})"
    return f"{Q.squeeze(f'(CASE WHEN {at} > 0 THEN {after} ELSE {other} END)')}[:300]"


def shorten_sql(x: str) -> str:
    s = f"regexp_replace({Q.repair(x)}, {CRE('(?is)' + fixed.SUBJECT_CUT[4:] + '.*$')}, '')"
    return f"nullif({Q.sub(s, r'^[ .,-]+|[ .,-]+$', '')}[:300], '')"


@query("D13_extract_subject", f"WITH {_NORM}, ln AS (SELECT *, {lines_sql('n')} AS ls FROM np), sj AS (SELECT edition_id, page, {subject_sql('ls')} AS subject FROM ln) SELECT *, {shorten_sql('subject')} AS short FROM sj")
def _(t):
    s = X.extract_subject("text", CONFIG)
    p = t.spread("gz_pages").select("edition_id", "page", s.alias("subject"))
    return p.withColumn("short", X.shorten_subject("subject", CONFIG))


def value_sql(x: str) -> str:
    def norm(v):
        return Q.sub(f"regexp_replace(trim({v}), '(?i)^R\\s*[$S]', 'R$')", r"^[.,;:]+|[.,;:]+$", "")
    raw = f"list_transform(regexp_extract_all({x}, {CRE(fixed.MONEY)}), lambda v: {norm('v')})"
    num = "regexp_replace(v, '[^\\d,.]', '', 'g')"
    num = f"(CASE WHEN contains({num}, ',') THEN replace(replace({num}, '.', ''), ',', '.') ELSE {num} END)"
    amt = f"coalesce(CASE WHEN regexp_full_match({num}, '\\d+\\.?\\d*|\\.\\d+') THEN try_cast({num} AS DOUBLE) END, 0)"
    ams = f"list_transform({raw}, lambda v: {amt})"
    lab = f"nullif(regexp_extract({x}, {CRE(fixed.MONEY_AFTER_LABEL)}, 1), '')"
    return f"(CASE WHEN {lab} IS NOT NULL THEN {norm(lab)} ELSE ({raw})[list_position({ams}, list_max({ams}))] END)"


@query("D14_extract_value", f"SELECT edition_id, page, {value_sql('text')} AS value, {value_sql(chr(39) + 'R S 10,50 ' + chr(39) + ' || replace(text, ' + chr(39) + 'valor de' + chr(39) + ', ' + chr(39) + chr(39) + ')')} AS largest FROM gz_pages")
def _(t):
    bare = F.concat(F.lit("R S 10,50 "), F.replace(F.col("text"), F.lit("valor de"), F.lit("")))
    return t.spread("gz_pages").select("edition_id", "page", X.extract_value("text").alias("value"), X.extract_value(bare).alias("largest"))


def header_sql(x: str) -> str:
    return f"(len(list_filter({lines_sql(x)}, lambda s: regexp_matches({Q.fold('s')}, {CRE(fixed.TITLE_LINE)}) OR regexp_matches({Q.fold('s')}, {CRE(fixed.SUBJECT_LABEL)}))) > 0)"


_CONT = fixed.CONTINUATION.replace("|assinado", "|joao silva|assinado")


@query("D15_line_predicates", f"""SELECT edition_id, page, {starts_sql('text')} AS starts, {header_sql('text')} AS header, {footer_sql('text')} AS footer,
  regexp_matches({Q.fold(Q.squeeze('text') + '[:140]')}, {CRE(_CONT)}) AS continuation FROM gz_pages""")
def _(t):
    return t.spread("gz_pages").select("edition_id", "page", X.line_starts_act("text").alias("starts"), X.has_act_header("text").alias("header"),
                             X.is_footer_line(F.col("text"), CONFIG).alias("footer"), X.is_continuation("text", CONFIG).alias("continuation"))


def foreign_sql(x: str) -> str:
    full = Q.fold(Q.squeeze(Q.txt(x)))

    def org(names: str) -> str:
        return (rf"\b(prefeitura(\s+municipal)?(\s+do)?(\s+municipio)?\s+(de\s+)?({names})|camara(\s+municipal)?\s+(de\s+)?({names})|municipio\s+(de\s+)?({names})|"
                rf"prefeit[oa](\s+municipal)?\s+(de\s+)?({names}))\b")

    own_org = (f"(regexp_matches({full}[:500], '\\b(prefeitura|camara|municipio|prefeito)(\\s+\\w+){{0,4}}\\s+{KEY}\\b') OR "
               f"{Q.any_of(full + '[:400]', (f'prefeitura municipal de {KEY}', f'camara municipal de {KEY}', f'municipio de {KEY}'))})")
    own = f"({_TAX.replace('{d}', Q.digits(x))} AND {own_org})"
    dom = " OR ".join(f"(contains({full}[:120], {CRE(n)}) AND regexp_matches({full}[:600], {CRE(org(n))}))" for n in Q.NEIGHBOURS)
    by = f"(regexp_matches({full}[:600], {CRE(org('|'.join(Q.NEIGHBOURS)))}) AND (NOT {own} OR {dom}))"
    short = f"(regexp_matches({full}[:80], 'prefeitura|camara|municipio') AND NOT contains({full}[:120], '{KEY}') AND {Q.any_of(full + '[:140]', Q.NEIGHBOURS)})"
    return f"({by} OR {short})"


def suspect_sql(organ: str, excerpt: str) -> str:
    o = Q.fold(Q.txt(organ))
    return f"(NOT contains({o}, '{KEY}') AND NOT ({_TAX.replace('{d}', Q.digits(excerpt))} AND {o} = '') AND {foreign_sql(excerpt)})"


@query("D16_foreign_entity", f"""SELECT edition_id, page, {foreign_sql('text')} AS is_foreign, {suspect_sql("CASE WHEN page % 2 = 0 THEN 'Prefeitura Municipal' END", 'text')} AS suspect FROM gz_pages""")
def _(t):
    organ = F.when(F.col("page") % 2 == 0, "Prefeitura Municipal")
    return t.spread("gz_pages").select("edition_id", "page", X.foreign_entity("text", CONFIG).alias("is_foreign"), X.suspect_foreign(organ, "text", CONFIG).alias("suspect"))


# ---- D17-D19 -------------------------------------------------------------------------------

_K3 = "edition_id, page, seg_no"
FIELDS_CTE = f"""{SEG_CTE}, {mentions_cte('segs')},
sn AS (SELECT edition_id, page, seg_no, block, {Q.scan('text')} AS n FROM segs),
mc AS (SELECT {_K3}, count(*) AS n_terms FROM men GROUP BY ALL), {type_cte('sn', _K3)},
sl AS (SELECT *, {lines_sql('n')} AS ls, {Q.fold('n')} AS f FROM sn),
fl AS (SELECT s.edition_id, s.page, s.seg_no, s.block, s.n AS text, s.f, len(s.ls) AS n_lines, {category_sql('s.n')} AS category, {foreign_sql('s.n')} AS foreign_, {organ_sql('s.n')} AS organ,
  ty.act_type AS kind, ty.number AS num, {header_sql('s.n')} AS header, {_m(fixed.SUBJECT_LABEL, 's.f')} AS label, {Q.any_of('s.f', fixed.FISCAL_WORDS)} AS fiscal,
  {_TAX.replace('{d}', Q.digits('s.n'))} AS own_tax, length({Q.strip('s.n')}) >= 400 AS long_, {subject_sql('s.ls')} AS subj, coalesce(mc.n_terms, 0) > 0 AS has_terms
  FROM sl s LEFT JOIN ty USING ({_K3}) LEFT JOIN mc USING ({_K3}))"""
_OF = Q.fold(Q.txt("organ"))
_SF = Q.fold(Q.txt("subj"))
ACTS_CTE = f"""g0 AS (SELECT *, organ IS NOT NULL AS ho, kind IS NOT NULL AS hk, contains({_OF}, '{KEY}') AS ours, category = 'publicacao_oficial' AS off FROM fl WHERE category <> 'patrocinador_distribuicao' AND NOT foreign_),
g1 AS (SELECT *, off AND ho AND NOT hk AND NOT label AND NOT fiscal AS need_long FROM g0),
g2 AS (SELECT *, hk OR (need_long AND ours AND regexp_matches(f, 'aditivo|contrato|clausula')) AS typed FROM g1),
g3 AS (SELECT * FROM g2 WHERE (ho OR has_terms) AND NOT (NOT hk AND NOT ho AND regexp_matches({Q.fold(Q.squeeze('text') + '[:140]')}, {CRE(_CONT)})) AND NOT (off AND NOT (ho OR hk OR fiscal))
  AND NOT (ho AND NOT hk AND NOT label AND NOT fiscal AND NOT (ours AND long_ AND own_tax) AND (subj IS NULL OR {footer_sql('subj')}))
  AND NOT (need_long AND NOT (ours AND long_)) AND NOT (category = 'materia_jornalistica' AND NOT (ho OR hk OR header OR fiscal)) AND (ho OR typed OR fiscal)
  AND NOT (ho AND NOT typed AND NOT fiscal AND (n_lines <= 3 OR ({_SF} <> '' AND (contains({_SF}, {_OF}[:20]) OR contains({_OF}, {_SF})))))),
g4 AS (SELECT edition_id, page, seg_no, block, CASE WHEN category = 'materia_jornalistica' AND (hk OR header OR fiscal) THEN 'publicacao_oficial' ELSE category END AS category, organ,
  coalesce(kind, CASE WHEN need_long AND ours AND regexp_matches(f, 'aditivo|contrato|clausula') THEN CASE WHEN contains(f, 'aditivo') THEN 'Termo Aditivo' ELSE 'Contrato' END END) AS kind,
  num, text, subj FROM g3),
g5 AS (SELECT edition_id, page, seg_no, block, category, organ, {Q.act_type('kind')} AS act_type, {Q.valid_number('num')} AS number, {date_sql('text')} AS doc_date, {shorten_sql('subj')} AS subject,
  {value_sql('text')} AS value, {Q.repair('text')} AS excerpt FROM g4)"""
_ACOLS = "edition_id, page, seg_no, block, category, organ, act_type, number, doc_date, subject, value, excerpt"


@query("D17_act_from_segment", f"WITH {FIELDS_CTE}, {ACTS_CTE} SELECT {_ACOLS} FROM g5")
def _(t):
    return D.acts_from_segments(D.act_fields(D.detect(t.spread("gz_pages"), CONFIG).segments, CONFIG), CONFIG)


def family_sql(x: str) -> str:
    f = Q.fold(Q.txt(x))
    c = lambda w: f"contains({f}, '{w}')"
    return f"""(CASE WHEN {f} = '' THEN 'sem_tipo' WHEN {c('extrato')} AND {c('contrato')} THEN 'extrato_contrato' WHEN {c('extrato')} AND {c('rescis')} THEN 'extrato_rescisao'
      WHEN {c('termo')} AND {c('aditivo')} THEN 'termo_aditivo' WHEN {c('homolog')} OR {c('adjudic')} THEN 'homologacao' WHEN {c('dispensa')} THEN 'dispensa' WHEN {c('contrato')} THEN 'contrato'
      WHEN {c('portaria')} THEN 'portaria' WHEN {c('decreto')} THEN 'decreto' WHEN {c('edital')} THEN 'edital' WHEN starts_with({f}, 'lei') THEN 'lei' ELSE {f}[:40] END)"""


def organ_family_sql(x: str) -> str:
    f = Q.fold(Q.txt(x))
    return f"""(CASE WHEN contains({f}, 'camara') THEN 'camara' WHEN contains({f}, 'prefeitura') OR contains({f}, 'municipio') THEN 'executivo' WHEN contains({f}, 'conselho') THEN 'conselho'
      WHEN contains({f}, 'fundo') THEN 'fundo' WHEN {f} <> '' THEN {f}[:30] ELSE 'sem_orgao' END)"""


def signature_sql(*cols: str) -> str:
    blob = f"regexp_replace({Q.fold(' || chr(32) || '.join(Q.txt(c) for c in cols))}, '\\s+', ' ', 'g')"
    words = "[" + ", ".join(CRE(w) for w in fixed.SIGNATURE_KEYWORDS) + "]"
    return f"""array_to_string(list_sort(list_distinct(list_concat(list_filter({words}, lambda w: contains({blob}, w)),
      list_transform(regexp_extract_all({blob}, {CRE(fixed.SIGNATURE_AMOUNTS)}), lambda s: replace(s, '.', '')))))[1:8], '|')"""


def key_sql(number: str, page: str, kind: str, organ: str, sig: str, excerpt: str) -> str:
    num = Q.fold(f"coalesce({Q.valid_number(number)}, '')")
    cut = f"regexp_replace({Q.fold(f'{Q.txt(excerpt)}[:200]')}, '\\s+', ' ', 'g')"
    fam, org, p = family_sql(kind), organ_family_sql(organ), f"coalesce(CAST({page} AS VARCHAR), '')"
    fams = ", ".join(CRE(f) for f in fixed.SIGNED_FAMILIES)
    return f"""(CASE WHEN {num} <> '' THEN {p} || '|' || {fam} || '|' || {num} || '|' || {org} WHEN {sig} <> '' AND {fam} IN ({fams}) THEN {p} || '|' || {fam} || '|' || {org} || '|sig:' || {sig}
      ELSE {p} || '|' || {fam} || '|' || {org} || '|' || CASE WHEN length({cut}) > 80 THEN {cut}[41:120] ELSE {cut}[:80] END END)"""


RAW_CTE = f"""k0 AS (SELECT *, {signature_sql('act_type', 'subject', 'NULL', 'excerpt', 'NULL')} AS sig FROM g5),
k1 AS (SELECT * EXCLUDE (sig), {key_sql('number', 'page', 'act_type', 'organ', 'sig', 'excerpt')} AS dk, {suspect_sql('organ', 'excerpt')} AS suspect, {foreign_sql('excerpt')} AS ff FROM k0),
raw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edition_id, dk ORDER BY page, seg_no) AS rn FROM k1 WHERE NOT suspect) WHERE rn = 1)"""


@query("D18_detect", f"WITH {FIELDS_CTE}, {ACTS_CTE}, {RAW_CTE} SELECT {_ACOLS} FROM raw WHERE NOT ff")
def _(t):
    return D.detect(t.spread("gz_pages"), CONFIG).acts


@query("D18_detect_rollup", f"""WITH {FIELDS_CTE}, {ACTS_CTE}, {RAW_CTE}, {DEDUP_MEN},
m AS (SELECT edition_id, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages, array_to_string(list_sort(list(DISTINCT label)), '|') AS terms, count(*) AS n FROM dmen GROUP BY 1),
a AS (SELECT edition_id, count(*) AS n FROM raw WHERE NOT ff GROUP BY 1)
SELECT e.edition_id, coalesce(m.n, 0) + coalesce(a.n, 0) > 0 AS found, coalesce(m.pages, '') AS pages, coalesce(m.terms, '') AS terms, coalesce(m.n, 0) AS n_mentions, coalesce(a.n, 0) AS n_acts
FROM (SELECT DISTINCT edition_id FROM gz_pages) e LEFT JOIN m USING (edition_id) LEFT JOIN a USING (edition_id)""")
def _(t):
    r = D.detect(t.spread("gz_pages"), CONFIG).rollup()
    return r.withColumns({"pages": F.array_join("pages", ","), "terms": F.array_join("terms", "|")})


@query("D19_detection_metrics", f"""WITH {FIELDS_CTE}, {ACTS_CTE}, {RAW_CTE}, {DEDUP_MEN},
d1 AS (SELECT edition_id, count(*) AS n FROM fl WHERE foreign_ AND (category = 'publicacao_oficial' OR has_terms) GROUP BY 1),
d2 AS (SELECT edition_id, count(*) AS n FROM k1 WHERE suspect GROUP BY 1), r AS (SELECT edition_id, count(*) AS n, count(*) FILTER (ff) AS d3 FROM raw GROUP BY 1),
m AS (SELECT edition_id, count(*) AS n FROM dmen GROUP BY 1),
p AS (SELECT edition_id, count(*) AS pages, count(*) FILTER (length({Q.strip('text')}) < 100 OR (contains(method, 'ocr') AND NOT contains(method, 'pdfplumber'))) AS weak_pages FROM gz_pages GROUP BY 1)
SELECT edition_id, coalesce(r.n, 0) AS raw_acts, coalesce(r.n - r.d3, 0) AS final_acts, CAST(0 AS BIGINT) AS model_drops, coalesce(d1.n, 0) + coalesce(d2.n, 0) + coalesce(r.d3, 0) AS neighbour_drops,
  pages, weak_pages, coalesce(m.n, 0) AS mentions FROM p LEFT JOIN d1 USING (edition_id) LEFT JOIN d2 USING (edition_id) LEFT JOIN r USING (edition_id) LEFT JOIN m USING (edition_id)""")
def _(t):
    return D.detect(t.spread("gz_pages"), CONFIG).metrics()
