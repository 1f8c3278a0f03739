"""A-operators: sources, sinks and table updates. Sinks are written to the scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..sources import files as FI
from ..sources import listing as LI
from ..sources import ocr as O
from ..sources import store as S
from . import sqlx as Q
from .projections import AS_OF_DAY
from .q_functions import _slug
from .q_reports import SUM_CTE
from .registry import query


@query("A1_read_ocr_json", "SELECT edition_id, page, text, method FROM gz_pages")
def _(t):
    path = t.scratch("ocr-json")
    O.write_ocr_json(t.spread("gz_pages"), path)
    return O.document_pages(O.read_ocr_json(t.spark, path, lines=True)).drop("blocks")


@query("A2_write_ocr_json", """WITH b AS (SELECT page AS edition_id, CAST(page % 7 AS INTEGER) AS page, block, seq, text, l, t, r, b FROM gz_blocks)
SELECT edition_id, page, block, CAST(row_number() OVER (PARTITION BY edition_id, page ORDER BY seq) - 1 AS INTEGER) AS seq, text, l, t, r, b FROM b""")
def _(t):
    path = t.scratch("ocr-json")
    b = t.gz_blocks.withColumn("edition_id", F.col("page")).withColumn("page", (F.col("page") % 7).cast("int"))
    pages = b.select("edition_id", "page").distinct().withColumns({"text": F.lit("x"), "method": F.lit("ocr")})
    O.write_ocr_json(pages, path, b)
    return O.document_blocks(O.read_ocr_json(t.spark, path, lines=True))


_DOC = "'--- Página ' || page || ' (' || method || ') ---' || chr(10) || text"


@query("A3_assemble_document", f"SELECT edition_id, string_agg({_DOC}, chr(10) || chr(10) ORDER BY page) AS document FROM gz_pages GROUP BY 1")
def _(t):
    path = t.scratch("paged-text")
    O.write_paged_text(t.spread("gz_pages"), path)
    return O.read_documents(t.spark, path).withColumn("edition_id", F.col("edition_id").cast("bigint"))


@query("A3_read_paged_text", "SELECT edition_id, page, method, text FROM gz_pages")
def _(t):
    path = t.scratch("paged-text")
    O.write_paged_text(t.spread("gz_pages"), path)
    return O.read_paged_text(t.spark, path).withColumn("edition_id", F.col("edition_id").cast("bigint"))


_DAY = "lpad(CAST(1 + page_id % 31 AS STRING), 2, '0')"
_ADD = f"""'<a class="x" href="/ed/' || {_DAY} || '-0' || CAST(1 + page_id % 9 AS STRING) || '-2024.pdf">Edi&amp;ção <b>' || CAST(page_id AS STRING) || '</b></a><a href="mailto:a@b">05/05/2024</a><!-- <a href="z.pdf">z</a> --><a href=''sub/ler?x=1''>dia ' || {_DAY} || '/02/2023</a><a href="/ed/' || {_DAY} || '-0' || CAST(1 + page_id % 9 AS STRING) || '-2024.pdf"></a><iframe src="frame' || CAST(page_id % 3 AS STRING) || '.html"></iframe><embed src="//cdn.example/doc' || CAST(page_id AS STRING) || '.PDF"><object data="o.pdf"></object></nav>'"""
_HTML = f"replace(html, '</nav>', {_ADD})"
_HID = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"


def _unesc(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _resolve(h: str) -> str:
    b = "regexp_replace(url, '#.*$', '')"
    p = f"regexp_replace({b}, '\\?.*$', '')"
    o = f"regexp_extract({b}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*)', 1)"
    return f"""(CASE WHEN regexp_matches({h}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:') THEN {h} WHEN starts_with({h}, '//') THEN regexp_extract({b}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*:)', 1) || {h} WHEN starts_with({h}, '/') THEN {o} || {h}
      WHEN starts_with({h}, '?') THEN {p} || {h} WHEN starts_with({h}, '#') THEN {b} || {h} WHEN regexp_matches({p}, '://[^/]*/') THEN regexp_replace({p}, '[^/]*$', '') || {h} ELSE {p} || '/' || {h} END)"""


def _iso(x: str) -> str:
    return f"strftime(try_strptime(regexp_extract({x}, '\\b(\\d{{2}})[-/](\\d{{2}})[-/](\\d{{4}})\\b'), ['%d/%m/%Y', '%d-%m-%Y']), '%Y-%m-%d')"


_PAGES = f"pg AS (SELECT page_id, url, regexp_replace({_HTML}, {Q.lit(_HID)}, '', 'g') AS h FROM pages)"


def _html(t):
    return t.pages.select("page_id", "url", F.expr(_HTML).alias("html"))


@query("A4_extract_links", f"""WITH {_PAGES}, l AS (SELECT page_id, url, unnest(regexp_extract_all(h, {Q.lit(LI.ANCHOR)}, 1)) AS href, unnest(regexp_extract_all(h, {Q.lit(LI.ANCHOR)}, 2)) AS label, generate_subscripts(regexp_extract_all(h, {Q.lit(LI.ANCHOR)}, 1), 1) AS pos FROM pg),
c AS (SELECT page_id, url, pos, trim({_unesc('href')}) AS href, {Q.squeeze(_unesc("regexp_replace(label, '<[^>]*>', ' ', 'g')"))} AS label FROM l),
d AS (SELECT *, {_resolve('href')} AS link FROM c WHERE href <> '' AND NOT regexp_matches(href, '^(mailto:|tel:|javascript:)')),
e AS (SELECT *, coalesce({_iso('label')}, {_iso('link')}) AS day FROM d)
SELECT page_id, link AS url, arg_max_null(CASE WHEN label <> '' THEN label ELSE 'Edição ' || coalesce(day, string_split(link, '/')[-1]) END, pos) AS title, arg_max_null(day, pos) AS pub_date FROM e WHERE day IS NOT NULL OR contains(lower(link), '.pdf') GROUP BY 1, 2""")
def _(t):
    return LI.extract_links(_html(t))


_FIND = " || ".join(f"list_filter(list_transform(regexp_extract_all(h, {Q.lit(rf'(?is)<{tag}{chr(92)}b[^>]*?{chr(92)}b{attr}{chr(92)}s*={chr(92)}s*[' + chr(34) + chr(39) + '](' + '[^' + chr(34) + chr(39) + ']*)[' + chr(34) + chr(39) + ']')}, 1), lambda x: trim({_unesc('x')})), lambda x: contains(lower(x), '.pdf'))" for tag, attr in LI.DOCUMENT_TAGS)


@query("A5_resolve_document_link", f"""WITH {_PAGES}, f AS (SELECT page_id, url, ({_FIND})[1] AS href FROM (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN regexp_replace(h, '(?is)<a\\b[^>]*>', '', 'g') ELSE h END AS h FROM pg)) SELECT page_id, {_resolve('href')} AS document_url FROM f WHERE href IS NOT NULL""")
def _(t):
    p = _html(t).withColumn("html", F.when(F.col("page_id") % 2 == 0, F.regexp_replace("html", r"(?is)<a\b[^>]*>", "")).otherwise(F.col("html")))
    return LI.resolve_document_link(p)


_INC = """inc AS (SELECT url, CASE WHEN edition_id % 3 = 0 THEN '' ELSE title || ' v' || n END AS title, CASE WHEN edition_id % 2 = 0 THEN NULL ELSE '2002-01-0' || n END AS pub_date, n AS seq FROM gz_editions, (VALUES (1), (2)) v(n) WHERE edition_id % 4 > 0)"""


@query("A6_upsert_editions", f"""WITH {_INC}, old AS (SELECT url, title, pub_date FROM gz_editions WHERE edition_id % 5 > 0), l AS (SELECT url, arg_max(title, seq) FILTER (coalesce(title, '') <> '') AS nt, arg_min_null(title, seq) AS ft, arg_max(pub_date, seq) AS nd FROM inc GROUP BY 1)
SELECT coalesce(o.url, l.url) AS url, coalesce(l.nt, o.title, l.ft) AS title, coalesce(l.nd, o.pub_date) AS pub_date, o.url IS NULL AS inserted FROM old o FULL OUTER JOIN l ON o.url = l.url""")
def _(t):
    e = t.gz_editions
    n = e.where("edition_id % 4 > 0").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    inc = n.select("url", F.when(F.col("edition_id") % 3 == 0, "").otherwise(F.concat("title", F.lit(" v"), F.col("seq").cast("string"))).alias("title"),
                   F.when(F.col("edition_id") % 2 != 0, F.concat(F.lit("2002-01-0"), F.col("seq").cast("string"))).alias("pub_date"), "seq")
    return S.upsert_editions(e.where("edition_id % 5 > 0").select("url", "title", "pub_date"), inc)


@query("A7_new_editions", "SELECT url, pub_date FROM gz_editions e WHERE NOT EXISTS (SELECT 1 FROM gz_editions o WHERE o.url = e.url AND o.processed = 1) ORDER BY coalesce(pub_date, '') DESC, url LIMIT 10")
def _(t):
    e = t.gz_editions
    return S.new_editions(e.select("url", "pub_date"), e.where("processed = 1"), 10)


_NM = "regexp_replace(regexp_replace(CASE WHEN contains(r, '.') THEN r ELSE ti END, '[^A-Za-z0-9_.\\-]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("A8_safe_filename", f"""WITH s AS (SELECT page_id, title AS ti, pub, url_decode(replace(string_split(regexp_replace(regexp_replace(u, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/]*', ''), '/')[-1], '+', '%2B')) AS r FROM (
  SELECT page_id, CASE page_id % 3 WHEN 0 THEN url ELSE 'https://x.example/a/Edi%C3%A7%C3%A3o%20' || page_id || '-20266.PDF?y=1' END AS u, 'Edição nº ' || page_id || ' 20245' AS title, CASE WHEN page_id % 4 = 0 THEN NULL ELSE '2024-0' || (1 + page_id % 9) || '-11' END AS pub FROM pages)),
n AS (SELECT *, regexp_replace({_NM}, '\\b(2\\d{{3}})\\d+\\b', '\\1', 'g') AS n FROM s)
SELECT page_id, CASE WHEN suffix(lower(n), '.pdf') THEN n ELSE coalesce(nullif(n, ''), 'edicao') || '.pdf' END AS file, coalesce(substr(pub, 1, 4), 'sem-data') AS year, coalesce(substr(pub, 6, 2), '00') AS month FROM n""")
def _(t):
    i = F.col("page_id").cast("string")
    p = t.pages.select("page_id", F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("https://x.example/a/Edi%C3%A7%C3%A3o%20"), i, F.lit("-20266.PDF?y=1"))).alias("u"),
                       F.concat(F.lit("Edição nº "), i, F.lit(" 20245")).alias("title"),
                       F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("2024-0"), (1 + F.col("page_id") % 9).cast("string"), F.lit("-11"))).alias("pub"))
    d = FI.storage_partition("pub")
    return p.select("page_id", FI.safe_filename("u", "title").alias("file"), d["year"].alias("year"), d["month"].alias("month"))


_BIN = "CASE doc_id % 4 WHEN 0 THEN '%PDF-1.4 ' || text || ' %%EOF' WHEN 1 THEN '%PDF-1.4 %%EOF ' || text WHEN 2 THEN text ELSE '%PDF-' || substr(text, 1, 20) || '%%EOF' END"


@query("A9_audit_binaries", f"""SELECT path, bytes, md5, CASE WHEN bytes = 0 THEN 'empty' WHEN NOT starts_with(s, '%PDF-') THEN 'no_header' WHEN bytes < 50 THEN 'too_small' WHEN NOT contains(hex(s)[greatest(1, bytes * 2 - 2047):], '2525454F46') THEN 'no_end_mark' ELSE 'ok' END AS verdict
FROM (SELECT 'd' || doc_id || '.pdf' AS path, s, octet_length(encode(s)) AS bytes, md5(s) AS md5 FROM (SELECT doc_id, {_BIN} AS s FROM documents))""")
def _(t):
    d = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.encode(F.expr(_BIN), "UTF-8").alias("content"))
    return FI.audit_files(d.withColumn("length", F.length("content").cast("bigint")))


_EXP = ", ".join({"edition_title": "e.title AS edition_title", "pub_date": "e.pub_date"}.get(c, f"a.{c}") for c in fixed.EXPORT_FIELDS)
_AS_TEXT = ", ".join(f"nullif(CAST({c} AS VARCHAR), '') AS {c}" for c in fixed.EXPORT_FIELDS)


@query("A10_export_csv", f"SELECT {_AS_TEXT} FROM (SELECT {_EXP} FROM gz_acts a JOIN gz_editions e USING (edition_id))")
def _(t):
    path = t.scratch("csv")
    S.export_csv(S.export_rows(t.spread("gz_acts"), t.gz_editions), path)
    r = t.spark.read.options(sep=";", header=True, multiLine=True, escape='"').csv(path)
    return r.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in fixed.EXPORT_FIELDS])


@query("A11_export_json", f"SELECT {_EXP} FROM gz_acts a JOIN gz_editions e USING (edition_id)")
def _(t):
    path = t.scratch("json")
    rows = S.export_rows(t.spread("gz_acts"), t.gz_editions)
    S.export_json(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


_MIR = f"""mr AS (SELECT a.*, e.pub_date, e.title AS edition_title, e.url AS edition_url, coalesce(substr(e.pub_date, 1, 4), 'sem-data') AS year, coalesce(substr(e.pub_date, 6, 2), '00') AS month, coalesce(substr(e.pub_date, 9, 2), '00') AS day FROM gz_acts a JOIN gz_editions e USING (edition_id)),
ms AS (SELECT *, row_number() OVER (PARTITION BY year, month, day ORDER BY act_id) AS seq FROM mr),
mb AS (SELECT *, CASE WHEN seq < 10 THEN '0' ELSE '' END || seq || '_' || {_slug('act_type', 'Ato', 40)} || '_' || CASE WHEN coalesce(number, '') <> '' THEN {_slug('number', 's-n', 30)} ELSE 's-n' END || '__' || {_slug('organ', 'Orgao-nao-identificado', 50)} AS base,
  CASE WHEN year = 'sem-data' THEN 'sem-data' ELSE year || '-' || month || '-' || day END AS iso FROM ms)"""


@query("A12_mirror_acts", f"""WITH {_MIR} SELECT act_id, edition_id, 'por-data' AS tree, year || '/' || month || '/' || day AS folder, base AS file FROM mb
UNION ALL SELECT act_id, edition_id, 'por-tipo', {_slug('act_type', 'Outros', 40)} || '/' || year, iso || '__' || base FROM mb UNION ALL SELECT act_id, edition_id, 'por-orgao', {_slug('organ', 'Orgao-nao-identificado', 50)} || '/' || year, iso || '__' || base FROM mb""")
def _(t):
    return S.mirror_tree(S.mirror_rows(t.spread("gz_acts"), t.gz_editions))


@query("A12_mirror_written", f"WITH {_MIR} SELECT act_id, edition_id, seq, base FROM mb")
def _(t):
    path = t.scratch("mirror")
    rows = S.mirror_rows(t.spread("gz_acts"), t.gz_editions)
    S.write_mirror(rows, path)
    S.write_mirror(rows.where(F.col("year") == "1998"), path)  # a second run replaces only its own editions
    return t.spark.read.parquet(path).select("act_id", F.col("edition_id").cast("bigint").alias("edition_id"), "seq", "base")


def _y(x: str) -> str:
    s = f"replace(replace(coalesce({x}, ''), chr(10), ' '), '\"', '''')"
    return f"CASE WHEN regexp_matches({s}, '[:#\\[\\]{{}}]') OR {s} <> trim({s}) OR {s} = '' THEN '\"' || {s} || '\"' ELSE {s} END"


@query("A13_render_act_record", f"""WITH {_MIR} SELECT act_id, concat_ws(chr(10), '---', 'id: ' || act_id, 'edicao_id: ' || edition_id, 'seq: ' || seq, 'tipo: ' || {_y("coalesce(nullif(act_type, ''), 'Ato')")}, 'numero: ' || {_y('number')}, 'orgao: ' || {_y('organ')}, 'data_edicao: ' || {_y('pub_date')},
  'data_documento: ' || {_y('doc_date')}, 'valor: ' || {_y('value')}, 'pagina: ' || page, 'categoria: ' || {_y('category')}, 'edicao_titulo: ' || {_y('edition_title')}, '---', '', trim('# ' || coalesce(nullif(act_type, ''), 'Ato') || ' ' || coalesce(number, '')), '',
  '**Órgão:** ' || coalesce(nullif(organ, ''), '—'), '**Data da edição (jornal):** ' || coalesce(pub_date, '—'), '**Data do documento:** ' || coalesce(doc_date, '—'), '**Página no jornal:** ' || page, '**Valor:** ' || coalesce(nullif(value, ''), '—'), '', '## Resumo', '',
  coalesce(nullif(summary, ''), nullif(subject, ''), '_Sem resumo._'), '', '## Trecho', '', '```text', trim(excerpt), '```', '') AS markdown,
  json_object('id', act_id, 'edicao_id', edition_id, 'seq', seq, 'tipo', act_type, 'numero', number, 'orgao', organ, 'data_edicao', pub_date, 'data_documento', doc_date, 'valor', value, 'pagina', page, 'assunto', subject, 'resumo', summary, 'categoria', category, 'trecho', excerpt,
    'feedback', feedback, 'edicao_titulo', edition_title, 'edicao_url', edition_url)::VARCHAR AS record FROM ms""")
def _(t):
    rows = S.mirror_rows(t.spread("gz_acts"), t.gz_editions)
    return rows.select("act_id", S.render_markdown().alias("markdown"), S.render_json(rows).alias("record"))


@query("A14_mirror_index", f"WITH {_MIR} SELECT year, month, day, count(*) AS acts, CAST(grouping_id(year, month, day) AS INTEGER) AS level FROM mr GROUP BY ROLLUP (year, month, day)")
def _(t):
    return S.mirror_index(S.mirror_rows(t.gz_acts, t.gz_editions))


_CLS = "cl AS (SELECT pub_date, CASE edition_id % 3 WHEN 0 THEN 'falso_negativo' WHEN 1 THEN 'mencao_legitima' ELSE 'incerto' END AS class FROM gz_editions WHERE pub_date IS NOT NULL AND edition_id % 2 = 0)"


@query("A15_audit_report", f"""WITH {SUM_CTE}, {_CLS} SELECT 'money' AS section, 'n_valued' AS key, CAST(n_valued AS VARCHAR) AS value FROM sm UNION ALL SELECT 'money', 'n_unique', CAST(n_unique AS VARCHAR) FROM sm
UNION ALL SELECT 'types', coalesce(act_type, '(sem)'), CAST(count(*) AS VARCHAR) FROM gz_acts GROUP BY 2 UNION ALL SELECT 'classes', class, CAST(count(*) AS VARCHAR) FROM cl GROUP BY 2
UNION ALL SELECT 'only_mention', CAST(e.edition_id AS VARCHAR), (SELECT count(*) FROM gz_mentions m WHERE m.edition_id = e.edition_id) || '|' || coalesce(cl.class, 'nao_classificado') FROM gz_editions e LEFT JOIN cl USING (pub_date) WHERE has_target = 1 AND NOT EXISTS (SELECT 1 FROM gz_acts a WHERE a.edition_id = e.edition_id)""")
def _(t):
    k = F.col("edition_id") % 3
    cls = t.gz_editions.where("pub_date is not null and edition_id % 2 = 0").select("pub_date", F.when(k == 0, "falso_negativo").when(k == 1, "mencao_legitima").otherwise("incerto").alias("class"))
    return S.audit_report(t.gz_acts, t.gz_editions, t.gz_mentions, cls)


@query("A16_retention_plan", "SELECT edition_id, pub_date, path, bytes FROM gz_editions JOIN gz_files ON file_path = path WHERE processed = 1 AND has_target = 0 AND suffix(path, '.pdf') AND pub_date < CAST(DATE '2001-09-01' - 900 AS VARCHAR)")
def _(t):
    return FI.retention_plan(t.gz_editions, t.gz_files, AS_OF_DAY, 12)


@query("A16_expired_backups", "SELECT path, bytes FROM gz_files WHERE path NOT IN (SELECT path FROM gz_files ORDER BY modified DESC, path DESC LIMIT 7)")
def _(t):
    return FI.expired_backups(t.gz_files, 7).select("path", "bytes")


@query("A17_storage_usage", "SELECT 'edicoes' AS area, CASE WHEN suffix(path, '.ocr.json') THEN '.ocr.json' ELSE '.pdf' END AS ext, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM gz_files GROUP BY 2")
def _(t):
    return FI.storage_usage(t.gz_files)


@query("A18_reconcile_files", r"""WITH f AS (SELECT regexp_replace(string_split(path, '/')[-1], '(\.ocr)?\.[A-Za-z0-9]+$', '') AS base, bool_or(suffix(path, '.ocr.json')) AS ocr FROM gz_files GROUP BY 1),
e AS (SELECT edition_id, coalesce(file_path, text_path) AS p, processed, text_path, edition_id IN (SELECT edition_id FROM gz_acts WHERE coalesce(summary, '') <> '') AS enr FROM gz_editions WHERE coalesce(file_path, text_path) IS NOT NULL),
j AS (SELECT coalesce(f.base, regexp_replace(string_split(e.p, '/')[-1], '(\.ocr)?\.[A-Za-z0-9]+$', '')) AS base, e.*, f.ocr, f.base IS NOT NULL AS hf FROM e FULL OUTER JOIN f ON f.base = regexp_replace(string_split(e.p, '/')[-1], '(\.ocr)?\.[A-Za-z0-9]+$', ''))
SELECT base, edition_id, 'file_without_row' AS finding FROM j WHERE hf AND edition_id IS NULL UNION ALL SELECT base, edition_id, 'row_without_file' FROM j WHERE NOT hf UNION ALL SELECT base, edition_id, 'text_not_processed' FROM j WHERE text_path IS NOT NULL AND processed = 0
UNION ALL SELECT base, edition_id, 'read_not_enriched' FROM j WHERE ocr AND NOT coalesce(enr, false)""")
def _(t):
    return FI.reconcile_files(t.gz_files, t.gz_editions, t.gz_acts)


@query("A19_replace_by_edition", "SELECT act_id, edition_id, act_type FROM gz_acts WHERE edition_id % 3 > 0 UNION ALL SELECT act_id + 1000000, edition_id, 'novo' FROM gz_acts WHERE edition_id % 3 = 0 AND act_id % 2 = 0 UNION ALL SELECT act_id, edition_id, act_type FROM gz_acts WHERE edition_id % 3 = 0 AND edition_id NOT IN (SELECT edition_id FROM gz_acts WHERE edition_id % 3 = 0 AND act_id % 2 = 0)")
def _(t):
    a = t.gz_acts.select("act_id", "edition_id", "act_type")
    new = a.where("edition_id % 3 = 0 and act_id % 2 = 0").withColumns({"act_id": F.col("act_id") + 1000000, "act_type": F.lit("novo")})
    return S.replace_by_edition(a, new)


@query("A19_replace_written", "SELECT CAST(year AS INTEGER) AS year, CASE WHEN year = 1998 THEN 'novo' ELSE act_type END AS act_type, act_id FROM (SELECT act_id, act_type, edition_id // 10000 AS year FROM gz_acts)")
def _(t):
    path = t.scratch("acts")
    a = t.gz_acts.select("act_id", F.floor(F.col("edition_id") / 10000).cast("int").alias("edition_id"), "act_type")
    S.write_by_edition(a, path)
    S.write_by_edition(a.where("edition_id = 1998").withColumn("act_type", F.lit("novo")), path)
    return t.spark.read.parquet(path).select(F.col("edition_id").alias("year"), "act_type", "act_id")


