"""B1-B8, B23, B24, B28 - text helpers as column expressions (all JVM-side)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..config import DetectionConfig

ColumnLike = Column | str


def col(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def compute_once(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add costly columns so that they are evaluated exactly once per row.

    Filters on plain projected columns are pushed below the projection, which would evaluate the expressions twice
    (and carry them into join conditions). A one-element ``inline`` is a boundary the optimizer does not move filters
    across, and it stays inside generated code.
    """
    kept = [F.col(c) for c in df.columns if c not in exprs]
    return df.select(*kept, F.inline_outer(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))))


def text(x: ColumnLike) -> Column:
    """NULL becomes the empty string."""
    return F.coalesce(col(x), F.lit(""))


def filled(x: ColumnLike) -> Column:
    """True when a text field holds something (NULL and '' are empty)."""
    return F.coalesce(F.length(col(x)) > 0, F.lit(False))


def nonblank(x: ColumnLike) -> Column:
    """True when a text field holds something besides blanks."""
    return F.coalesce(F.length(F.trim(col(x))) > 0, F.lit(False))


def fold(x: ColumnLike) -> Column:
    """B1 - lower case without accents; keeps the length so offsets stay valid in the original text. Plain ASCII holds
    no accents and is left as it is."""
    return let(F.lower(col(x)), lambda low: F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, fixed.FOLD_FROM, fixed.FOLD_TO)))


def squeeze(x: ColumnLike) -> Column:
    """B2 - one blank between words, none at the ends. A single blank stays as it is and is not replaced."""
    return F.trim(F.regexp_replace(col(x), r"[^\S ]\s*| \s+", " "))


def any_contains(x: Column, words: Iterable[str]) -> Column:
    """True if the text holds any of the given words. The text is evaluated once."""
    def test(v: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(v, F.lit(w))
        return out

    return let(x, test)


def rx(pattern: str) -> str:
    """Case-insensitive patterns must also ignore the case of accented letters."""
    return pattern.replace("(?i)", "(?iu)")


def replace_all(x: Column, rules: Iterable[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        x = F.regexp_replace(x, rx(pattern), replacement)
    return x


def _literal_start(pattern: str) -> str:
    """Plain letters that every match of a pattern begins with, in lower case ('' if there is no telling)."""
    start = re.match(r"[A-Za-z]*", pattern)[0]
    if "|" in pattern:
        return ""
    return (start[:-1] if pattern[len(start):len(start) + 1] in ("?", "*", "{") else start).lower()


#: Pieces besides the stem that every organ name cut short holds; none has a letter (i, k, s) that others match regardless of case.
CUT_ORGANS = ((r"PREFEITURA\s+MUNICIPAL", "tura"), (r"C[AÂ]MARA\s+MUNICIPAL", "mara"), (r"MUNIC[IÍ]PIO", "mun"))


def scan_rules(cfg: DetectionConfig) -> list[tuple[str, str, str]]:
    """Ordered rewrite list of B3 as (trigger, pattern, replacement). Rules are data; the target name and tax ids come
    from the config. A trigger is a lower-case piece every match holds; '' means the pattern is always tried."""
    return [r[:3] for r in _triggered_rules(cfg)]


def _triggered_rules(cfg: DetectionConfig) -> list[tuple[str, str, str, str]]:
    """The rules with a second piece that every match holds ('' if there is none)."""
    rules = [(t, *r, "") for t, r in zip(fixed.GLUED_TRIGGERS, fixed.GLUED_TITLES)]
    rules += [(_literal_start(v), rf"(?i)\b{v}\b", cfg.target, "") for v in cfg.scan_variants]
    rules += [(t, *r, "con" if "CONTRATO" in r[0] else "") for t, r in zip(fixed.CUT_TRIGGERS, fixed.CUT_TITLES)]
    if cfg.truncated_stem:
        stem = cfg.truncated_stem
        rest, head = cfg.target[len(stem):], cfg.key[len(stem):][:2]
        for organ, piece in CUT_ORGANS:
            rules.append((stem.lower(), rf"(?i)\b({organ}\s+DE\s+{stem})\b(?!\s*{head})", "$1" + rest, piece))
    gap = r"[\s.\-_/|]*"
    for tax in cfg.tax_ids:
        a, b, c = tax[:2], tax[3:6], tax[7:10]
        d, e = tax[-2], tax[-1]
        rules.append((b, f"{a}{gap}{b}{gap}{c}{gap}0*0*0*1{gap}{d}?{e}?", tax, c))
    return rules


def normalize_scan(x: ColumnLike, cfg: DetectionConfig) -> Column:
    """B3 - undo frequent scan errors in titles, the target name and its tax ids.

    Most rules do not apply to most texts, so a cheap search for the trigger decides whether a pattern is run: in the text as
    it came, made lower-case once, for its own trigger and those of earlier rules that may write it."""
    rules = _triggered_rules(cfg)

    def holds(low: Column, piece: str, i: int) -> Column:
        any_of = {piece, *(t for t, _, written, _ in rules[:i] if piece in written.lower())}
        return F.lit(True) if "" in any_of else any_contains(low, sorted(any_of))

    def wanted(low: Column, i: int) -> Column:
        return holds(low, rules[i][0], i) & holds(low, rules[i][3], i)

    def chain(t: Column, low: Column) -> Column:
        out = t
        for i, (_, pattern, replacement, _) in enumerate(rules):
            out = let(out, lambda now: F.when(wanted(low, i), F.regexp_replace(now, rx(pattern), replacement)).otherwise(now))
        return out

    return let(text(x), lambda t: let(F.lower(t), lambda low: chain(t, low)))


def repair_scan(x: ColumnLike, cfg: DetectionConfig, clean: bool = False) -> Column:
    """B4 - B3 plus literal repairs, then squeezed. ``clean`` says that B3 has been done (it is idempotent)."""
    out = text(x) if clean else normalize_scan(x, cfg)
    for wrong, right in fixed.LITERAL_REPAIRS:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    key = cfg.key.replace("_", "[_]")
    mail = f"prefeitura@{cfg.key}.pr.gov.br"

    def addresses(t: Column) -> Column:
        mended = F.regexp_replace(F.regexp_replace(t, rf"(?i)prefeitura[gq@d]{key}\.?\s*pr\.?\s*gov\.?\s*br", mail), rf"(?i)www {key}\.pr gov br", f"www.{cfg.key}.pr.gov.br")
        return F.when(F.contains(F.lower(t), F.lit("gov")), mended).otherwise(t)

    return squeeze(let(out, addresses))


def clean_excerpt(x: ColumnLike, limit: int | None = None) -> Column:
    """B5 - drop control characters, squeeze blanks inside lines, at most one empty line; cut only if a limit is given."""
    out = F.regexp_replace(text(x), fixed.CONTROL_CHARS, "")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = replace_all(F.replace(out, F.lit("LEINº"), F.lit("LEI Nº")),
                      [r for r in fixed.GLUED_TITLES if "LEIN[" not in r[0]])
    return cut_at(strip(out), limit)


def cut_at(x: Column, limit: int | None) -> Column:
    return x if limit is None else F.substring(x, 1, limit)


def strip(x: Column) -> Column:
    """Strip any blanks including line ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def context(x: ColumnLike, start: Column, end: Column, margin: int = 180) -> Column:
    """B6 - raw text around the 0-based span [start, end)."""
    lo = F.greatest(F.lit(0), start - margin)
    return F.substring(col(x), lo + 1, end + margin - lo)


def snippet(x: ColumnLike, start: Column, end: Column, margin: int = 120) -> Column:
    """B6 - squeezed context between ellipses."""
    return F.concat(F.lit("..."), squeeze(context(x, start, end, margin)), F.lit("..."))


def abbreviate(x: ColumnLike, n: int = 150) -> Column:
    """B7 - squeezed and cut to n characters."""
    s = squeeze(text(x))
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n - 3), F.lit("...")))


def slugify(x: ColumnLike, default: str = "sem-nome", max_len: int = 60) -> Column:
    """B8 - name that is safe in a path (accents stripped, case kept)."""
    up_from = fixed.FOLD_FROM + fixed.FOLD_FROM[:-2].upper().replace("Ÿ", "")
    up_to = fixed.FOLD_TO + fixed.FOLD_TO[:-3].upper()
    s = F.translate(strip(text(x)), up_from, up_to)
    s = replace_all(s, ((r"[/\\]", "-"), (r'[<>:"|?*\x00-\x1f]', ""), (r"[\s_]+", "-"),
                        (r"[^\p{L}\p{N}_\-]+", ""), (r"-{2,}", "-"), (r"^[\-._]+|[\-._]+$", "")))
    cut = F.regexp_replace(F.substring(s, 1, max_len), r"-+$", "")
    return F.when(F.length(s) > 0, cut).otherwise(F.lit(default))


def act_base_name(seq: ColumnLike, act_type: ColumnLike, number: ColumnLike, organ: ColumnLike) -> Column:
    """B8 - file stem of an act record."""
    num = F.when(filled(number), slugify(number, "s-n", 30)).otherwise(F.lit("s-n"))
    s = col(seq).cast("string")
    return F.concat(
        F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s), F.lit("_"), slugify(act_type, "Ato", 40),
        F.lit("_"), num, F.lit("__"), slugify(organ, "Orgao-nao-identificado", 50))


def significant_tokens(x: ColumnLike) -> Column:
    """B23 - distinct tokens of three or more characters without stop words."""
    toks = F.regexp_extract_all(fold(text(x)), F.lit("([a-z0-9]{3,})"), 1)
    return F.array_except(toks, F.array(*[F.lit(w) for w in fixed.STOP_TOKENS]))


def query_tokens(x: ColumnLike) -> Column:
    """B23 - tokens of a search text, in order, repeats kept."""
    return F.regexp_extract_all(fold(text(x)), F.lit("([a-z0-9]{2,})"), 1)


def digits(x: ColumnLike) -> Column:
    """B24 - only the digits."""
    return F.regexp_replace(text(x), r"\D+", "")


def has_entity_taxid(x: ColumnLike, cfg: DetectionConfig) -> Column:
    """B24 - the first six digits of a tax root appear in the digits of the text (deliberately permissive), whatever stands
    between them."""
    roots = [r"\D*+".join(r[:6]) for r in cfg.tax_roots]
    return text(x).rlike("|".join(roots)) if roots else F.lit(False)


def postal_code_matches(x: ColumnLike, cfg: DetectionConfig) -> Column:
    """B24 - the postal code starts with one of the configured prefixes."""
    d = F.replace(text(x), F.lit("-"), F.lit(""))
    out = F.lit(False)
    for p in cfg.postal_prefixes:
        out = out | d.startswith(p.replace("-", ""))
    return out


def title_case(x: ColumnLike) -> Column:
    """Capital after every non-letter, as in a printed title."""
    parts = F.split(F.regexp_replace(F.lower(col(x)), r"(\p{L}+)", "\u0001$1\u0001"), "\u0001")
    return F.array_join(F.transform(parts, F.initcap), "")


def mention_hash(page: ColumnLike, excerpt: ColumnLike) -> Column:
    """B28 - identity of a mention inside an edition."""
    return F.md5(F.concat_ws("|", col(page).cast("string"), squeeze(text(excerpt))))


def sha1_12(x: ColumnLike) -> Column:
    """B28 - short content hash."""
    return F.substring(F.sha1(text(x)), 1, 12)


def first_match(x: Column, pattern: str, group: int = 0) -> Column:
    """First regex match or NULL."""
    return F.nullif(F.regexp_extract(x, rx(pattern), group), F.lit(""))


def count_of(x: Column, token: Column) -> Column:
    """Non-overlapping occurrences of a non-empty token."""
    return ((F.length(x) - F.length(F.replace(x, token, F.lit("")))) / F.length(token)).cast("int")


def offsets_of(x: Column, pattern: str) -> Column:
    """0-based offsets of all matches: a marker is put before every match and the pieces are measured."""
    pieces = F.split(F.regexp_replace(x, pattern, "\u0001$0"), "\u0001")
    lengths = F.transform(pieces, lambda p: F.length(p))
    sums = F.aggregate(
        F.slice(lengths, 1, F.greatest(F.size(lengths) - 1, F.lit(0))), F.array().cast("array<int>"),
        lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))
    return sums


def spans_of(x: Column, pattern: str) -> Column:
    """0-based (o, n) offset and length of all matches, from one pass over the text."""
    def measure(pieces: Column) -> Column:
        found = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.struct(
            (F.length(p) - 1).alias("len"), (F.instr(p, "\u0002") - 1).alias("n")))
        start = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), F.array().cast("array<struct<o:int,n:int>>").alias("out"))
        return F.aggregate(found, start, lambda acc, p: F.struct(
            (acc["at"] + p["len"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("o"), p["n"].alias("n")))).alias("out")))["out"]

    return let(F.split(F.regexp_replace(x, pattern, "\u0001$0\u0002"), "\u0001"), measure)


def spaced(offsets: Column, gap: int) -> Column:
    """Greedy subset of sorted offsets that are at least ``gap`` apart."""
    return F.aggregate(
        offsets, F.array().cast("array<int>"),
        lambda acc, o: F.when((F.size(acc) == 0) | (o - F.try_element_at(acc, F.lit(-1)) >= gap), F.concat(acc, F.array(o)))
        .otherwise(acc))
