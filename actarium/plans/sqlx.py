"""Fragments of the checking SQL (one expression text in, one out). Kept apart from the operators."""

from __future__ import annotations

from .. import fixed
from .projections import CONFIG

KEY = "nation_5"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def txt(x: str) -> str:
    return f"coalesce({x}, '')"


def fold(x: str) -> str:
    return f"translate(lower({x}), {lit(fixed.FOLD_FROM)}, {lit(fixed.FOLD_TO)})"


def sub(x: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(repl)}, 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$", "")


def digits(x: str) -> str:
    return f"regexp_replace({txt(x)}, '\\D', '', 'g')"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def filled(x: str) -> str:
    return f"(coalesce({x}, '') <> '')"


def nonblank(x: str) -> str:
    return f"(trim(coalesce({x}, '')) <> '')"


def scan(x: str) -> str:
    out = txt(x)
    for p, r in fixed.GLUED_TITLES:
        out = sub(out, p, r)
    out = sub(out, r"(?i)\bNAT\s*ION_5\b", "NATION_5")
    out = sub(out, r"(?i)\bNATIQN_5\b", "NATION_5")
    for p, r in fixed.CUT_TITLES:
        out = sub(out, p, r)
    for organ in (r"PREFEITURA\s+MUNICIPAL", r"C[AÂ]MARA\s+MUNICIPAL", r"MUNIC[IÍ]PIO"):
        out = sub(out, rf"(?i)\b({organ}\s+DE\s+NAT)\b", r"\1ION_5")
    g = r"[\s.\-_/|]*"
    out = sub(out, rf"11{g}222{g}333{g}0*0*0*1{g}8?1?", "11.222.333/0001-81")
    return sub(out, rf"44{g}555{g}666{g}0*0*0*1{g}7?7?", "44.555.666/0001-77")


def repair(x: str) -> str:
    out = scan(x)
    for a, b in fixed.LITERAL_REPAIRS:
        out = f"replace({out}, {lit(a)}, {lit(b)})"
    out = sub(out, r"(?i)prefeitura[gq@d]nation_5\.?\s*pr\.?\s*gov\.?\s*br", "prefeitura@nation_5.pr.gov.br")
    out = sub(out, r"(?i)www nation_5\.pr gov br", "www.nation_5.pr.gov.br")
    return squeeze(out)


def title(x: str) -> str:
    parts = f"string_split(regexp_replace(lower({x}), '(\\p{{L}}+)', chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    return f"array_to_string(list_transform({parts}, lambda w: upper(w[1:1]) || w[2:]), '')"


def year_in(x: str) -> str:
    s = strip(txt(x))
    out = []
    for p, g in ((r"^(\d{4})", 1), (r"(\d{2})[/-](\d{2})[/-](\d{4})", 3), (r"(\d{4})", 1)):
        y = f"try_cast(regexp_extract({s}, {lit(p)}, {g}) AS INTEGER)"
        out.append(f"CASE WHEN {y} BETWEEN 1990 AND 2100 THEN {y} END")
    return f"coalesce({', '.join(out)})"


def parse_money(x: str) -> str:
    s = strip(sub(txt(x), r"[Rr]\$| ", ""))
    n = (f"CASE WHEN contains({s}, ',') AND contains({s}, '.') THEN replace(replace({s}, '.', ''), ',', '.') "
         f"WHEN contains({s}, ',') THEN replace({s}, ',', '.') ELSE {s} END")
    return f"CASE WHEN regexp_full_match({n}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN try_cast({n} AS DOUBLE) END"


def money_text(x: str) -> str:
    return (f"CASE WHEN {x} >= 1000000 THEN 'R$ ' || format('{{:.2f}}', {x} / 1000000) || 'M' "
            f"WHEN {x} > 0 THEN 'R$ ' || translate(format('{{:,.2f}}', {x}), ',.', '.,') ELSE 'R$ 0,00' END")


def norm_money(x: str) -> str:
    v = sub(strip(txt(x)), r"(?is)^.*?(R\s*[$S])", r"\1")
    v = sub(v, r"(?i)^R\s*[$S]\s*", "R$ ")
    return f"nullif({sub(v, r'^[.,;:]+|[.,;:]+$', '')}, '')"


def valid_number(x: str) -> str:
    n = sub(strip(txt(x)), r"^[.,;:]+|[.,;:]+$", "")
    sep = r"^(\d{1,6})\s*[/\-]\s*(\d{2,4})$"
    y = f"regexp_extract({n}, {lit(sep)}, 2)"
    y = f"(CASE WHEN length({y}) = 2 THEN '20' || {y} ELSE {y} END)"
    return f"""(CASE WHEN {n} = '' THEN NULL
      WHEN regexp_full_match({n}, '\\d{{7,}}') THEN CASE WHEN regexp_matches(right({n}, 4), '^(19|20)') AND length({n}) <= 8 THEN {n}[:-5] || '/' || right({n}, 4) END
      WHEN regexp_matches({n}, {lit(sep)}) THEN CASE WHEN regexp_matches({y}, '^(19|20)') AND try_cast({y} AS INTEGER) BETWEEN 1990 AND 2100 THEN regexp_extract({n}, {lit(sep)}, 1) || '/' || {y} END
      WHEN regexp_full_match({n}, '\\d{{1,5}}') THEN {n}
      WHEN length({n}) <= 12 AND regexp_matches({n}, '\\d') THEN {n} END)"""


def act_type(x: str) -> str:
    raw = squeeze(txt(x))
    key = f"({fold(raw)} || ' ')"
    whens = " ".join(f"WHEN contains({key}, {lit(p + ' ')}) THEN {lit(n)}" for p, n in fixed.TYPE_LABELS)
    return (f"(CASE WHEN {raw} = '' THEN NULL {whens} WHEN starts_with({key}, 'ato ') THEN 'Ato' "
            f"WHEN length({raw}) <= 40 THEN {title(raw)} ELSE {raw}[:60] END)")


def generic_type(x: str) -> str:
    return f"(trim({fold(f'coalesce({act_type(x)}, {txt(x)})')}) IN ({', '.join(lit(g) for g in fixed.GENERIC_TYPES)}))"


def organ(x: str) -> str:
    o = strip(txt(x))
    k = fold(o)
    return f"""(CASE WHEN {o} = '' THEN NULL WHEN contains({k}, 'camara') AND contains({k}, '{KEY}') THEN 'Câmara Municipal de NATION_5'
      WHEN contains({k}, 'prefeitura') AND contains({k}, '{KEY}') THEN 'Prefeitura Municipal de NATION_5'
      WHEN starts_with({k}, 'municipio de {KEY}') THEN 'Município de NATION_5' ELSE {o} END)"""


def theme(x: str) -> str:
    k = f"translate({fold(strip(txt(x)))}, ' -', '__')"
    whens = [f"WHEN {k} IN ({', '.join(lit(t) for t in fixed.THEMES)}) THEN {k}"]
    whens += [f"WHEN {k} = {lit(a)} THEN {lit(t)}" for a, t in fixed.THEME_ALIASES]
    whens += [f"WHEN contains({k}, {lit(a)}) OR contains({lit(a)}, {k}) THEN {lit(t)}" for a, t in fixed.THEME_ALIASES]
    whens += [f"WHEN contains({k}, {lit(t)}) THEN {lit(t)}" for t in fixed.THEMES]
    return f"(CASE WHEN {k} = '' THEN NULL {' '.join(whens)} ELSE 'outros' END)"


def significant(x: str) -> str:
    stop = ", ".join(lit(w) for w in fixed.STOP_TOKENS)
    return f"list_filter(list_distinct(regexp_extract_all({fold(txt(x))}, '[a-z0-9]{{3,}}')), lambda t: t NOT IN ({stop}))"


def joined(lst: str, sep: str = "|") -> str:
    return f"coalesce(array_to_string({lst}, {lit(sep)}), '')"


NEIGHBOURS = tuple(CONFIG.neighbour_keys)
