"""B-operators over whole texts and whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..functions import values as V
from . import sqlx as Q
from .projections import AS_OF_TS, AS_OF_YEAR, CONFIG
from .registry import query


def _joined(x, sep="|"):
    return F.array_join(x, sep)


@query("B1_fold", f"SELECT doc_id, {Q.fold('text')} AS folded FROM documents")
def _(t):
    return t.documents.select("doc_id", T.fold("text").alias("folded"))


@query("B2_squeeze", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed FROM documents")
def _(t):
    return t.documents.select("doc_id", T.squeeze("text").alias("squeezed"))


@query("B3_normalize_ocr", f"SELECT page, {Q.scan('text')} AS text FROM gz_pages")
def _(t):
    return t.gz_pages.select("page", T.normalize_scan("text", CONFIG).alias("text"))


@query("B4_correct_ocr_basic", f"SELECT page, {Q.repair('text')} AS text FROM gz_pages")
def _(t):
    return t.gz_pages.select("page", T.repair_scan("text", CONFIG).alias("text"))


_CLEAN = Q.sub(Q.sub(Q.sub(Q.txt("text"), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{200b}-\x{200f}\x{feff}]", ""), r"[ \t]+", " "), r"\n{3,}", "\n\n")
_CLEAN = f"replace({_CLEAN}, 'LEINº', 'LEI Nº')"
for _p, _r in (fixed.GLUED_TITLES[0], fixed.GLUED_TITLES[2], fixed.GLUED_TITLES[3]):
    _CLEAN = Q.sub(_CLEAN, _p, _r)


@query("B5_clean_excerpt", f"""SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, {Q.strip(_CLEAN)} AS text FROM documents
  UNION ALL SELECT 'p' || CAST(page AS VARCHAR), {Q.strip(_CLEAN)} FROM gz_pages""")
def _(t):
    docs = t.documents.select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    pages = t.gz_pages.select(F.concat(F.lit("p"), F.col("page")).alias("id"), "text")
    return docs.unionAll(pages).select("id", T.clean_excerpt("text").alias("text"))


@query("B6_snippet", """
SELECT doc_id, CASE WHEN p >= 0 THEN '...' || trim(regexp_replace(substr(text, greatest(0, p - 120) + 1, p + 2 + 120 - greatest(0, p - 120)), '\\s+', ' ', 'g')) || '...' END AS snippet,
  CASE WHEN p >= 0 THEN substr(text, greatest(0, p - 180) + 1, p + 2 + 180 - greatest(0, p - 180)) END AS context
FROM (SELECT doc_id, text, instr(lower(text), 'de') - 1 AS p FROM documents)""")
def _(t):
    d = t.documents.withColumn("p", F.instr(F.lower("text"), "de") - 1)
    p = F.col("p")
    return d.select("doc_id", F.when(p >= 0, T.snippet("text", p, p + 2)).alias("snippet"), F.when(p >= 0, T.context("text", p, p + 2)).alias("context"))


@query("B7_abbreviate", f"""SELECT doc_id, CASE WHEN length(s) <= 150 THEN s ELSE s[:147] || '...' END AS short
FROM (SELECT doc_id, {Q.squeeze('text')} AS s FROM documents)""")
def _(t):
    return t.documents.select("doc_id", T.abbreviate("text").alias("short"))


def _slug(x: str, default: str, n: int) -> str:
    s = f"strip_accents({Q.strip(Q.txt(x))})"
    for p, r in ((r"[/\\]", "-"), (r'[<>:"|?*]', ""), (r"[\s_]+", "-"), (r"[^\p{L}\p{N}_\-]+", ""), (r"-{2,}", "-"), (r"^[\-._]+|[\-._]+$", "")):
        s = Q.sub(s, p, r)
    return f"(CASE WHEN {s} = '' THEN {Q.lit(default)} ELSE regexp_replace({s}[:{n}], '-+$', '') END)"


@query("B8_slugify", f"""SELECT act_id, {_slug('subject', 'sem-nome', 60)} AS slug,
  lpad(CAST(page AS VARCHAR), 2, '0') || '_' || {_slug('act_type', 'Ato', 40)} || '_' ||
  CASE WHEN {Q.filled('number')} THEN {_slug('number', 's-n', 30)} ELSE 's-n' END || '__' || {_slug('organ', 'Orgao-nao-identificado', 50)} AS base FROM gz_acts""")
def _(t):
    return t.gz_acts.select("act_id", T.slugify("subject").alias("slug"),
                            T.act_base_name("page", "act_type", "number", "organ").alias("base"))


@query("B9_parse_br_date", r"""
SELECT act_id, strftime(try_strptime(regexp_extract(s, '\b(\d{2})[-/](\d{2})[-/](\d{4})\b'), ['%d/%m/%Y', '%d-%m-%Y']), '%Y-%m-%d') AS iso
FROM (SELECT act_id, coalesce(doc_date, '') || ' ' || coalesce(excerpt, '') AS s FROM gz_acts)""")
def _(t):
    return t.gz_acts.select("act_id", V.parse_br_date(F.concat_ws(" ", T.text("doc_date"), "excerpt")).alias("iso"))


@query("B10_edition_date_parts", r"""
SELECT act_id, coalesce(nullif(regexp_extract(s, '^(\d{4})-(\d{2})-(\d{2})', 1), ''), nullif(regexp_extract(s, '^(\d{2})/(\d{2})/(\d{4})', 3), ''), 'sem-data') AS y,
  coalesce(nullif(regexp_extract(s, '^(\d{4})-(\d{2})-(\d{2})', 2), ''), nullif(regexp_extract(s, '^(\d{2})/(\d{2})/(\d{4})', 2), ''), '00') AS m,
  coalesce(nullif(regexp_extract(s, '^(\d{4})-(\d{2})-(\d{2})', 3), ''), nullif(regexp_extract(s, '^(\d{2})/(\d{2})/(\d{4})', 1), ''), '00') AS d
FROM (SELECT act_id, trim(CASE WHEN page % 2 = 0 THEN created_day ELSE coalesce(doc_date, '') END)[:10] AS s FROM gz_acts)""")
def _(t):
    raw = F.when(F.col("page") % 2 == 0, F.col("created_day")).otherwise(F.col("doc_date"))
    p = V.edition_date_parts(raw)
    return t.gz_acts.select("act_id", p["year"].alias("y"), p["month"].alias("m"), p["day"].alias("d"))


_MONTHS = " ".join(f"WHEN '{m}' THEN '{i + 1:02d}'" for i, m in enumerate(fixed.MONTHS))
_LONG = r"(?i)^(\d{1,2})\s+de\s+([a-zçãéíóú]+)\s+de\s+(\d{4})"
_NUM = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"
NORM_DATE = f"""(CASE WHEN {{d}} = '' THEN NULL
  WHEN regexp_matches({{d}}, {Q.lit(_LONG)}) AND (CASE {Q.fold(f"regexp_extract({{d}}, {Q.lit(_LONG)}, 2)")} {_MONTHS} END) IS NOT NULL
    THEN lpad(regexp_extract({{d}}, {Q.lit(_LONG)}, 1), 2, '0') || '/' || (CASE {Q.fold(f"regexp_extract({{d}}, {Q.lit(_LONG)}, 2)")} {_MONTHS} END) || '/' || regexp_extract({{d}}, {Q.lit(_LONG)}, 3)
  WHEN regexp_matches({{d}}, {Q.lit(_NUM)}) THEN lpad(regexp_extract({{d}}, {Q.lit(_NUM)}, 1), 2, '0') || '/' || lpad(regexp_extract({{d}}, {Q.lit(_NUM)}, 2), 2, '0') || '/' ||
    CASE WHEN length(regexp_extract({{d}}, {Q.lit(_NUM)}, 3)) = 2 THEN '20' ELSE '' END || regexp_extract({{d}}, {Q.lit(_NUM)}, 3)
  ELSE {{d}}[:40] END)"""


def norm_date_sql(x: str) -> str:
    return NORM_DATE.replace("{d}", Q.strip(Q.txt(x)))


@query("B11_normalize_document_date", f"SELECT act_id, {norm_date_sql('doc_date')} AS doc_date, {norm_date_sql('summary')} AS odd FROM gz_acts")
def _(t):
    return t.gz_acts.select("act_id", V.normalize_document_date("doc_date").alias("doc_date"),
                            V.normalize_document_date("summary").alias("odd"))


@query("B12_reference_year", f"""SELECT act_id, coalesce({Q.year_in("CASE WHEN page = 1 THEN NULL ELSE created_day END")}, {Q.year_in('doc_date')}, {AS_OF_YEAR}) AS ref_year,
  coalesce({Q.year_in('doc_date')}, {AS_OF_YEAR}) AS doc_year FROM gz_acts""")
def _(t):
    day = F.when(F.col("page") != 1, F.col("created_day"))
    return t.gz_acts.select("act_id", V.reference_year(day, "doc_date", AS_OF_YEAR).alias("ref_year"),
                            V.reference_year(F.lit(None), "doc_date", AS_OF_YEAR).alias("doc_year"))


@query("B13_parse_money", f"""SELECT act_id, {Q.parse_money('value')} AS amount, {Q.parse_money("'R$ 1.' || CAST(page AS VARCHAR)")} AS dotted FROM gz_acts""")
def _(t):
    return t.gz_acts.select("act_id", V.parse_money("value").alias("amount"),
                            V.parse_money(F.concat(F.lit("R$ 1."), F.col("page").cast("string"))).alias("dotted"))


@query("B14_format_money", f"""SELECT o_orderkey, {Q.money_text('o_totalprice')} AS money, {Q.money_text('o_totalprice * 97')} AS big FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", V.format_money("o_totalprice").alias("money"), V.format_money(F.col("o_totalprice") * 97).alias("big"))


@query("B15_normalize_money_text", f"SELECT act_id, {Q.norm_money('value')} AS value, {Q.norm_money('summary')} AS from_summary FROM gz_acts")
def _(t):
    return t.gz_acts.select("act_id", V.normalize_money_text("value").alias("value"), V.normalize_money_text("summary").alias("from_summary"))


def variants_sql(x: str) -> str:
    d = Q.digits(x)
    nz = f"coalesce(nullif(ltrim({d}, '0'), ''), {d})"
    return f"""list_sort(list_distinct(list_filter([{d}, {nz},
      CASE WHEN suffix({d}, '00') AND length({d}) > 4 THEN {d}[:-3] END,
      CASE WHEN suffix({d}, '00') AND length({d}) > 4 THEN coalesce(nullif(ltrim({d}[:-3], '0'), ''), {d}[:-3]) END,
      CASE WHEN length({nz}) >= 6 THEN right({nz}, 6) END, CASE WHEN length({nz}) >= 7 THEN right({nz}, 7) END,
      CASE WHEN length({nz}) >= 8 THEN right({nz}, 8) END], lambda v: v IS NOT NULL AND length(v) >= 3)))"""


@query("B16_money_digit_variants", f"""SELECT act_id, {Q.joined(variants_sql('value'))} AS variants,
  {Q.joined(variants_sql("'R$ 0' || CAST(act_id AS VARCHAR) || '.000,00'"))} AS rounded FROM gz_acts""")
def _(t):
    rounded = F.concat(F.lit("R$ 0"), F.col("act_id").cast("string"), F.lit(".000,00"))
    return t.gz_acts.select("act_id", _joined(V.money_digit_variants("value")).alias("variants"),
                            _joined(V.money_digit_variants(rounded)).alias("rounded"))


@query("B17_normalize_act_number", r"""
SELECT act_id, CASE WHEN number IS NULL THEN NULL
  WHEN regexp_full_match(n, '\d{6,8}') THEN CASE WHEN regexp_matches(right(n, 4), '^(19|20)') THEN n[:-5] || '/' || right(n, 4) ELSE '' END ELSE n END AS number
FROM (SELECT act_id, number, regexp_replace(trim(coalesce(number, '')), '^[.,;:]+|[.,;:]+$', '', 'g') AS n FROM gz_acts)""")
def _(t):
    return t.gz_acts.select("act_id", V.normalize_act_number("number").alias("number"))


@query("B18_valid_act_number", f"""SELECT act_id, {Q.valid_number('number')} AS number, {Q.valid_number("' ' || CAST(page AS VARCHAR) || ' - ' || CAST(confidence AS VARCHAR) || '.'")} AS odd FROM gz_acts""")
def _(t):
    odd = F.concat(F.lit(" "), F.col("page").cast("string"), F.lit(" - "), F.col("confidence").cast("string"), F.lit("."))
    return t.gz_acts.select("act_id", V.valid_act_number("number").alias("number"), V.valid_act_number(odd).alias("odd"))


@query("B19_split_act_number", r"""SELECT act_id, nullif(regexp_extract(trim(coalesce(number, '')), '^(\d{1,6})/(\d{4})$', 1), '') AS seq,
  try_cast(regexp_extract(trim(coalesce(number, '')), '^(\d{1,6})/(\d{4})$', 2) AS INTEGER) AS year FROM gz_acts""")
def _(t):
    return t.gz_acts.select("act_id", V.number_seq("number").alias("seq"), V.number_year("number").alias("year"))


@query("B20_normalize_organ", f"SELECT act_id, {Q.organ('organ')} AS organ FROM gz_acts")
def _(t):
    return t.gz_acts.select("act_id", V.normalize_organ("organ", CONFIG).alias("organ"))


@query("B21_normalize_act_type", f"""SELECT act_id, {Q.act_type('act_type')} AS act_type, {Q.act_type("substr(excerpt, 1, page * 6)")} AS loose FROM gz_acts""")
def _(t):
    loose = F.substring(F.col("excerpt"), F.lit(1), F.col("page") * 6)
    return t.gz_acts.select("act_id", V.normalize_act_type("act_type").alias("act_type"), V.normalize_act_type(loose).alias("loose"))


@query("B22_normalize_themes", f"""SELECT act_id, {Q.theme('act_type')} AS theme, coalesce((SELECT array_to_string(list(th ORDER BY p)[:5], '|') FROM (
    SELECT th, min(p) AS p FROM (SELECT {Q.theme('x')} AS th, p FROM (SELECT trim(unnest(string_split(themes, ','))) AS x, generate_subscripts(string_split(themes, ','), 1) AS p)) WHERE th IS NOT NULL GROUP BY th)), '') AS themes
  FROM gz_acts""")
def _(t):
    return t.gz_acts.select("act_id", V.normalize_theme("act_type").alias("theme"), _joined(V.normalize_themes("themes")).alias("themes"))


@query("B23_tokens", f"""SELECT doc_id, {Q.joined(f"list_sort({Q.significant('text')})")} AS tokens,
  CAST(len(regexp_extract_all({Q.fold('text')}, '[a-z0-9]{{2,}}')) AS INTEGER) AS n_query FROM documents""")
def _(t):
    return t.documents.select("doc_id", _joined(F.array_sort(T.significant_tokens("text"))).alias("tokens"),
                              F.size(T.query_tokens("text")).alias("n_query"))


@query("B24_digits_taxid_postal", f"""SELECT page, {Q.digits('text')} AS digits, (contains({Q.digits('text')}, '112223') OR contains({Q.digits('text')}, '445556')) AS own_tax,
  starts_with(replace(regexp_replace(coalesce(nullif(regexp_extract(text, '\\b87\\.?\\d{{3}}-\\d{{3}}\\b'), ''), ''), '\\.', '', 'g'), '-', ''), '87670') AS own_postal FROM gz_pages""")
def _(t):
    cep = F.replace(F.regexp_extract("text", r"\b87\.?\d{3}-\d{3}\b", 0), F.lit("."), F.lit(""))
    return t.gz_pages.select("page", T.digits("text").alias("digits"), T.has_entity_taxid("text", CONFIG).alias("own_tax"),
                             T.postal_code_matches(cep, CONFIG).alias("own_postal"))


FLAGS_SQL = """CASE WHEN trim(coalesce(flags, '')) = '' THEN []::VARCHAR[] WHEN NOT json_valid(flags) THEN [flags]
  WHEN json_type(flags) = 'ARRAY' THEN from_json(flags, '["VARCHAR"]') ELSE [flags ->> '$'] END"""


@query("B25_merge_flags", f"""SELECT act_id, array_to_string(list_concat(f, list_filter(['a', 'leve', 'novo'], lambda x: NOT list_contains(f, x))), '|') AS flags
FROM (SELECT act_id, {FLAGS_SQL} AS f FROM gz_acts)""")
def _(t):
    new = F.array(F.lit("a"), F.lit("leve"), F.lit("novo"), F.lit(""), F.lit("novo"))
    return t.gz_acts.select("act_id", _joined(V.merge_flags("flags", new)).alias("flags"))


_CUT = "substr(response, 1, length(response) - CAST(act_id % 40 AS INTEGER))"


@query("B26_repair_json", f"""WITH c AS (SELECT act_id, {_CUT} AS c, rtrim({_CUT}) AS r FROM gz_responses),
k AS (SELECT act_id, list_filter([c,
  CASE WHEN (length(r) - length(replace(r, '"', ''))) % 2 = 1 THEN r || '"' END,
  CASE WHEN length(replace(r, '}}', '')) > length(replace(r, '{{', '')) THEN r || repeat('}}', CAST(length(replace(r, '}}', '')) - length(replace(r, '{{', '')) AS BIGINT)) END,
  CASE WHEN suffix(r, ',') THEN rtrim(r, ',') || '}}' END,
  CASE WHEN suffix(r, '"') OR suffix(r, '}}') THEN r || '}}' END,
  CASE WHEN contains(r, ',') THEN regexp_replace(r, '^(.*),[^,]*$', '\\1', 's') || '}}' END,
  CASE WHEN instr(c, '"}}') > 1 THEN regexp_replace(c, '^(.*"}}).*$', '\\1', 's') || '}}' END], lambda x: x IS NOT NULL AND x <> '' AND json_valid(x) AND NOT regexp_matches(x, ',\\s*}}')) AS good FROM c)
SELECT act_id, good[1] AS repaired FROM k""".replace("{{", "{").replace("}}", "}"))
def _(t):
    cut = F.substring(F.col("response"), F.lit(1), F.length("response") - (F.col("act_id") % 40).cast("int"))
    return t.gz_responses.select("act_id", V.repair_json(cut).alias("repaired"))


@query("B27_parse_json_or_empty", """SELECT act_id, CASE WHEN starts_with(trim(coalesce(validation, '')), '{') AND json_valid(validation) THEN trim(validation) ELSE '{}' END AS validation FROM gz_acts""")
def _(t):
    return t.gz_acts.select("act_id", V.json_object_or_empty("validation").alias("validation"))


@query("B28_hashes", f"""SELECT mention_id, md5(CAST(page AS VARCHAR) || '|' || {Q.squeeze('excerpt')}) AS mention_hash, substr(sha1(excerpt), 1, 12) AS h12 FROM gz_mentions""")
def _(t):
    return t.gz_mentions.select("mention_id", T.mention_hash("page", "excerpt").alias("mention_hash"), T.sha1_12("excerpt").alias("h12"))


@query("B29_age_eta_labels", f"""SELECT event_id,
  CASE WHEN s < 0 THEN 'agora' WHEN s < 60 THEN 'há instantes' WHEN s // 60 < 60 THEN 'há ' || (s // 60) || ' min'
    WHEN s // 3600 < 48 THEN 'há ' || (s // 3600) || 'h ' || (s // 60 % 60) || 'min' ELSE 'há ' || (s // 86400) || 'd' END AS age,
  CASE WHEN e <= 0 AND e > -120 THEN 'agora' WHEN e <= 0 AND -e // 60 < 60 THEN 'atrasado ' || (-e // 60) || ' min'
    WHEN e <= 0 THEN 'atrasado ' || (-e // 3600) || 'h ' || (-e // 60 % 60) || 'min' WHEN e < 60 THEN 'em menos de 1 min' WHEN e // 60 < 60 THEN 'em ' || (e // 60) || ' min'
    WHEN e // 3600 < 48 THEN 'em ' || (e // 3600) || 'h ' || lpad(CAST(e // 60 % 60 AS VARCHAR), 2, '0') || 'min' ELSE 'em ' || (e // 86400) || 'd ' || (e // 3600 % 24) || 'h' END AS eta
FROM (SELECT event_id, CAST(epoch(TIMESTAMP '{AS_OF_TS}') - floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) - epoch(TIMESTAMP '{AS_OF_TS}') AS BIGINT) AS e FROM events)""")
def _(t):
    now = F.lit(AS_OF_TS).cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", V.age_label(ts, now).alias("age"), V.eta_label(ts, now).alias("eta"))
