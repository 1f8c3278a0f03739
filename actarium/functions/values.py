"""B9-B22, B25-B27, B29 - dates, money, act numbers, canonical labels and JSON fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..config import DetectionConfig
from .text import (ColumnLike, col, digits, filled, first_match, fold, let, squeeze, strip, text,
                   title_case)

# ---- dates ---------------------------------------------------------------------------------


def parse_br_date(x: ColumnLike) -> Column:
    """B9 - first dd-mm-yyyy or dd/mm/yyyy as an ISO text, NULL when it is no calendar day."""
    pat = r"\b(\d{2})[-/](\d{2})[-/](\d{4})\b"
    iso = F.concat_ws("-", *[F.regexp_extract(text(x), pat, g) for g in (3, 2, 1)])
    return F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd")


def edition_date_parts(x: ColumnLike) -> Column:
    """B10 - struct(year, month, day), or the undated folder."""
    s = F.substring(strip(text(x)), 1, 10)
    iso, br = r"^(\d{4})-(\d{2})-(\d{2})", r"^(\d{2})/(\d{2})/(\d{4})"

    def part(gi: int, gb: int, default: str) -> Column:
        return F.coalesce(first_match(s, iso, gi), first_match(s, br, gb), F.lit(default))

    return F.struct(part(1, 3, "sem-data").alias("year"), part(2, 2, "00").alias("month"),
                    part(3, 1, "00").alias("day"))


def normalize_document_date(x: ColumnLike) -> Column:
    """B11 - dd/mm/yyyy from the long or the numeric form, else the first 40 characters."""
    d = strip(text(x))
    long_form = r"(?iu)^(\d{1,2})\s+de\s+([a-zçãéíóú]+)\s+de\s+(\d{4})"
    months = F.create_map(*[v for i, m in enumerate(fixed.MONTHS) for v in (F.lit(m), F.lit(f"{i + 1:02d}"))])
    month = F.try_element_at(months, fold(F.regexp_extract(d, long_form, 2)))
    num = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"
    year = F.regexp_extract(d, num, 3)
    return (
        F.when(F.length(d) == 0, None)
        .when(month.isNotNull(), F.concat_ws(
            "/", F.lpad(F.regexp_extract(d, long_form, 1), 2, "0"), month, F.regexp_extract(d, long_form, 3)))
        .when(d.rlike(num), F.concat_ws(
            "/", F.lpad(F.regexp_extract(d, num, 1), 2, "0"), F.lpad(F.regexp_extract(d, num, 2), 2, "0"),
            F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)))
        .otherwise(F.substring(d, 1, 40)))


def year_in(x: ColumnLike) -> Column:
    """First plausible year (1990-2100) of a date text: leading, then dd/mm/yyyy, then any four digits."""
    s = strip(text(x))
    found = [F.regexp_extract(s, r"^(\d{4})", 1), F.regexp_extract(s, r"(\d{2})[/-](\d{2})[/-](\d{4})", 3),
             F.regexp_extract(s, r"(\d{4})", 1)]
    years = [y.try_cast("int") for y in found]
    return F.coalesce(*[F.when(y.between(1990, 2100), y) for y in years])


def reference_year(edition_date: ColumnLike, document_date: ColumnLike, as_of_year: int | Column) -> Column:
    """B12 - year an act is judged against."""
    default = F.lit(as_of_year) if isinstance(as_of_year, int) else as_of_year
    return F.coalesce(year_in(edition_date), year_in(document_date), default)


def age_label(ts: ColumnLike, as_of: Column) -> Column:
    """B29 - how long ago."""
    s = F.unix_timestamp(as_of) - F.unix_timestamp(col(ts))
    mins = F.floor(s / 60)
    h = F.floor(mins / 60)
    return (
        F.when(s.isNull(), "—").when(s < 0, "agora").when(s < 60, "há instantes")
        .when(mins < 60, F.format_string("há %d min", mins))
        .when(h < 48, F.format_string("há %dh %dmin", h, mins % 60))
        .otherwise(F.format_string("há %dd", F.floor(h / 24))))


def eta_label(ts: ColumnLike, as_of: Column) -> Column:
    """B29 - how long until, or how late."""
    s = F.unix_timestamp(col(ts)) - F.unix_timestamp(as_of)
    mins = F.floor(s / 60)
    h = F.floor(mins / 60)
    late = F.floor(F.abs(s) / 60)
    return (
        F.when(s.isNull(), "—").when((s <= 0) & (s > -120), "agora")
        .when((s <= 0) & (late < 60), F.format_string("atrasado %d min", late))
        .when(s <= 0, F.format_string("atrasado %dh %dmin", F.floor(late / 60), late % 60))
        .when(mins < 1, "em menos de 1 min").when(mins < 60, F.format_string("em %d min", mins))
        .when(h < 48, F.format_string("em %dh %02dmin", h, mins % 60))
        .otherwise(F.format_string("em %dd %dh", F.floor(h / 24), h % 24)))


# ---- money ---------------------------------------------------------------------------------


def _number(s: Column) -> Column:
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


def parse_money(x: ColumnLike, br_strict: bool = False) -> Column:
    """B13 - ``R$ 1.234,56`` to a number, NULL if unreadable.

    A dot without a comma stays a decimal point (``R$ 1.500`` is 1.5); ``br_strict`` reads it as thousands.
    """
    def plain(s: Column) -> Column:
        out = F.when(F.contains(s, F.lit(",")), F.translate(s, ",.", "."))
        if br_strict:
            out = out.when(s.rlike(r"^\d{1,3}(\.\d{3})+$"), F.replace(s, F.lit("."), F.lit("")))
        return out.otherwise(s)

    return let(let(strip(F.regexp_replace(text(x), r"[Rr]\$| ", "")), plain), _number)


def money_amount(x: Column) -> Column:
    """Amount used to compare raw matches: 0 when unreadable."""
    def plain(s: Column) -> Column:
        return F.when(F.contains(s, F.lit(",")), F.translate(s, ",.", ".")).otherwise(s)

    return F.coalesce(let(let(F.regexp_replace(x, r"[^\d,.]", ""), plain), _number), F.lit(0.0))


def format_money(x: ColumnLike) -> Column:
    """B14 - Brazilian money text, millions abbreviated."""
    v = col(x)
    return (
        F.when(v >= 1_000_000, F.concat(F.lit("R$ "), F.replace(F.format_number(v / 1_000_000, 2), F.lit(","), F.lit("")), F.lit("M")))
        .when(v > 0, F.concat(F.lit("R$ "), F.translate(F.format_number(v, 2), ",.", ".,")))
        .otherwise("R$ 0,00"))


def normalize_money_match(x: Column) -> Column:
    """B15 - tidy a matched amount: the prefix becomes ``R$``, punctuation at the ends goes."""
    return F.regexp_replace(F.regexp_replace(F.trim(x), r"(?i)^R\s*[$S]", r"R\$"), r"^[.,;:]+|[.,;:]+$", "")


def normalize_money_text(x: ColumnLike) -> Column:
    """B15 - amount of an enrichment answer as ``R$ ...``: leading words dropped; empty becomes NULL."""
    v = strip(text(x))
    v = F.regexp_replace(v, r"(?is)^.*?(R\s*[$S])", "$1")
    v = F.regexp_replace(v, r"(?i)^R\s*[$S]\s*", r"R\$ ")
    return F.nullif(F.regexp_replace(v, r"^[.,;:]+|[.,;:]+$", ""), F.lit(""))


def money_digit_variants(x: ColumnLike) -> Column:
    """B16 - digit runs under which an amount may appear in a scanned text."""
    def bare(d: Column) -> Column:
        return F.coalesce(F.nullif(F.ltrim(d, F.lit("0")), F.lit("")), d)

    def forms(v: Column) -> Column:
        d, nz = v["d"], v["nz"]
        cut = F.when(d.endswith("00") & (F.length(d) > 4), F.substring(d, F.lit(1), F.length(d) - 2))
        cands = F.array(d, nz, cut, bare(cut), *[F.when(F.length(nz) >= n, F.right(nz, F.lit(n))) for n in (6, 7, 8)])
        return F.array_sort(F.array_distinct(F.filter(cands, lambda c: F.coalesce(F.length(c) >= 3, F.lit(False)))))

    return let(let(digits(x), lambda d: F.struct(d.alias("d"), bare(d).alias("nz"))), forms)


# ---- act numbers ---------------------------------------------------------------------------


def _bare(x: ColumnLike) -> Column:
    return F.regexp_replace(strip(text(x)), r"^[.,;:]+|[.,;:]+$", "")


def normalize_act_number(x: ColumnLike) -> Column:
    """B17 - split a glued number from its year; digit runs without a year become ''."""
    def split(v: Column) -> Column:
        glued, year = v.rlike(r"^\d{6,8}$"), F.right(v, F.lit(4))
        return (
            F.when(glued & year.rlike("^(19|20)"), F.concat(F.substring(v, F.lit(1), F.length(v) - 4), F.lit("/"), year))
            .when(glued, "").otherwise(v))

    return F.when(col(x).isNotNull(), let(_bare(x), split))


def valid_act_number(x: ColumnLike) -> Column:
    """B18 - the number in clean form, or NULL when it cannot be the number of an act."""
    sep = r"^(\d{1,6})\s*[/\-]\s*(\d{2,4})$"

    def with_year(n: Column) -> Column:
        y = F.regexp_extract(n, sep, 2)
        return let(F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y), lambda v: F.when(
            v.rlike("^(19|20)") & v.try_cast("int").between(1990, 2100), F.concat(F.regexp_extract(n, sep, 1), F.lit("/"), v)))

    def rules(n: Column) -> Column:
        return (
            F.when(n.rlike(r"^\d{7,}$"), F.when(n.rlike(r"^\d{3,4}(19|20)\d{2}$"), F.regexp_replace(n, r"^(\d+)(\d{4})$", "$1/$2")))
            .when(n.rlike(sep), with_year(n)).when(n.rlike(r"^\d{1,5}$"), n).when((F.length(n) <= 12) & n.rlike(r"\d"), n))

    return let(_bare(x), rules)


def number_seq(x: ColumnLike) -> Column:
    """B19 - sequence part of ``seq/yyyy``."""
    return first_match(F.trim(text(x)), r"^(\d{1,6})/(\d{4})$", 1)


def number_year(x: ColumnLike) -> Column:
    """B19 - year part of ``seq/yyyy``."""
    return F.regexp_extract(F.trim(text(x)), r"^(\d{1,6})/(\d{4})$", 2).try_cast("int")


# ---- labels --------------------------------------------------------------------------------


def normalize_organ(x: ColumnLike, cfg: DetectionConfig) -> Column:
    """B20 - canonical label of the target's organs; other organs are kept as written."""
    o = strip(text(x))
    k, t = fold(o), cfg.target
    own = F.contains(k, F.lit(cfg.key))
    return (
        F.when(F.length(o) == 0, None)
        .when(F.contains(k, F.lit("camara")) & own, f"Câmara Municipal de {t}")
        .when(F.contains(k, F.lit("prefeitura")) & own, f"Prefeitura Municipal de {t}")
        .when(k.startswith(f"municipio de {cfg.key}"), f"Município de {t}")
        .otherwise(o))


def normalize_act_type(x: ColumnLike) -> Column:
    """B21 - canonical act type by the first matching phrase of an ordered table."""
    raw = squeeze(text(x))

    def label(r: Column) -> Column:
        k = F.concat(fold(r), F.lit(" "))
        return let(k, lambda key: _type_chain(key, r))

    return F.when(F.length(raw) == 0, None).otherwise(let(raw, label))


def _type_chain(key: Column, raw: Column) -> Column:
    out = F.when(F.contains(key, F.lit(fixed.TYPE_LABELS[0][0] + " ")), fixed.TYPE_LABELS[0][1])
    for phrase, name in fixed.TYPE_LABELS[1:]:
        out = out.when(F.contains(key, F.lit(phrase + " ")), name)
    return (
        out.when(key.startswith("ato "), "Ato")
        .when(F.length(raw) <= 40, title_case(raw)).otherwise(F.substring(raw, 1, 60)))


def is_generic_type(x: ColumnLike) -> Column:
    """True if the type says nothing (empty, 'Outros', 'Ato', ...)."""
    return F.trim(fold(F.coalesce(normalize_act_type(x), F.lit("")))).isin(*fixed.GENERIC_TYPES)


def normalize_theme(x: ColumnLike) -> Column:
    """B22 - one of the 13 themes."""
    t = F.translate(fold(strip(text(x))), " -", "__")

    def chain(k: Column) -> Column:
        out = F.when(k.isin(*fixed.THEMES), k)
        exact: dict[str, list[str]] = {}
        for alias, theme in fixed.THEME_ALIASES:
            exact.setdefault(theme, []).append(alias)
        for theme, aliases in exact.items():
            out = out.when(k.isin(*aliases), theme)
        for alias, theme in fixed.THEME_ALIASES:
            out = out.when(F.contains(k, F.lit(alias)) | F.contains(F.lit(alias), k), theme)
        for theme in fixed.THEMES:
            out = out.when(F.contains(k, F.lit(theme)), theme)
        return out.otherwise("outros")

    return F.when(F.length(t) == 0, None).otherwise(let(t, chain))


def normalize_themes(x: ColumnLike, top: int = 5) -> Column:
    """B22 - distinct themes of a comma-separated list, first five, in order."""
    parts = F.filter(F.transform(F.split(text(x), ","), strip), lambda p: F.length(p) > 0)
    return F.slice(F.array_distinct(F.transform(parts, normalize_theme)), 1, top)


# ---- JSON in text --------------------------------------------------------------------------

FALSY_JSON = ("null", "false", "0", "0.0", "{}", '""', "[]")


def flag_list(x: ColumnLike) -> Column:
    """Flags stored as JSON text: a list as is, a scalar as one item, anything else as itself."""
    s = strip(text(x))
    valid = F.try_parse_json(s).isNotNull()
    return (
        F.when(F.length(s) == 0, F.array().cast("array<string>"))
        .when(valid & s.startswith("["), F.from_json(s, "array<string>"))
        .when(valid & s.isin(*FALSY_JSON), F.array().cast("array<string>"))
        .when(valid, F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>"))
        .otherwise(F.array(text(x))))


def merge_flags(x: ColumnLike, new: Column) -> Column:
    """B25 - append the new flags that are not yet there; empty flags are skipped."""
    return let(flag_list(x), lambda old: F.concat(
        old, F.array_distinct(F.filter(new, lambda f: filled(f) & ~F.array_contains(old, f)))))


def repair_json(x: ColumnLike) -> Column:
    """B26 - first way of closing a truncated JSON text that parses, else NULL."""
    content = text(x)

    def candidates(r: Column) -> Column:
        quotes = F.length(r) - F.length(F.replace(r, F.lit('"'), F.lit("")))
        opened = 2 * F.length(r) - F.length(F.replace(r, F.lit("{"), F.lit(""))) - F.length(r)
        opened = opened - (F.length(r) - F.length(F.replace(r, F.lit("}"), F.lit(""))))
        last_comma = F.length(r) - F.length(F.substring_index(r, ",", -1)) - 1
        tail = F.length(content) - F.length(F.substring_index(content, '"}', -1))
        cands = F.array(
            content,
            F.when(quotes % 2 == 1, F.concat(r, F.lit('"'))),
            F.when(opened > 0, F.concat(r, F.repeat(F.lit("}"), opened))),
            F.when(r.endswith(","), F.concat(F.rtrim(r, F.lit(",")), F.lit("}"))),
            F.when(r.endswith('"') | r.endswith("}"), F.concat(r, F.lit("}"))),
            F.when(F.contains(r, F.lit(",")), F.concat(F.substring(r, F.lit(1), last_comma), F.lit("}"))),
            F.when(F.contains(content, F.lit('"}')) & (tail > 2), F.concat(F.substring(content, F.lit(1), tail), F.lit("}"))))
        good = F.filter(cands, lambda c: filled(c) & F.try_parse_json(c).isNotNull())
        return F.try_element_at(good, F.lit(1))

    return let(F.regexp_replace(content, r"\s+$", ""), candidates)


def json_object_or_empty(x: ColumnLike) -> Column:
    """B27 - the JSON object text, or ``{}``."""
    s = strip(text(x))
    return F.when(s.startswith("{") & F.try_parse_json(s).isNotNull(), s).otherwise(F.lit("{}"))


