"""D7-D16 - fields of an act as column expressions over the text of a segment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..config import DetectionConfig, fold_py
from ..functions.text import (ColumnLike, any_contains, context, first_match, fold, has_entity_taxid, let,
                              normalize_scan, repair_scan, rx, squeeze, strip, text, title_case)
from ..functions.values import (money_amount, normalize_act_number, normalize_money_match, valid_act_number)


def lines_of(x: ColumnLike) -> Column:
    """Squeezed non-empty lines."""
    return F.filter(F.transform(F.split(text(x), "\n"), squeeze), lambda s: F.length(s) > 0)


def scanned(x: ColumnLike, cfg: DetectionConfig, clean: bool) -> Column:
    """Scan-normalised text; ``clean`` says that the caller has already done it (the rewrite is idempotent)."""
    return text(x) if clean else normalize_scan(x, cfg)


def line_rows(lines: Column, folded: Column | None = None) -> Column:
    """Lines with their folded text and two marks: title, subject label."""
    if folded is None:
        pairs = F.transform(lines, lambda s: F.struct(s.alias("s"), fold(s).alias("f")))
    else:
        pairs = F.arrays_zip(lines.alias("s"), folded.alias("f"))
    return F.transform(pairs, lambda r: F.struct(
        r["s"].alias("s"), r["f"].alias("f"), r["f"].rlike(fixed.TITLE_LINE).alias("title"), labelled_line(r["f"]).alias("label")))


def labelled_line(f: Column) -> Column:
    """A folded text carries a subject label; the pattern is tried only where one of its words stands."""
    return any_contains(f, ("sumula", "ementa", "objeto", "assunto")) & f.rlike(fixed.SUBJECT_LABEL)


def squeezed_lines(x: Column) -> Column:
    """As `lines_of`, with one pass over the whole text."""
    return F.filter(F.transform(F.split(F.regexp_replace(x, r"[^\S\n ][^\S\n]*| [^\S\n]+", " "), "\n"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def head(x: ColumnLike, n: int) -> Column:
    """Folded first n characters of the squeezed text."""
    return fold(F.substring(squeeze(text(x)), 1, n))


# ---- D4 / D7 -------------------------------------------------------------------------------


def sponsor_context(x: Column, start: Column, end: Column, cfg: DetectionConfig) -> Column:
    """D4 - the surroundings are an advertisement. Configured words that fold alike count twice."""
    return let(fold(context(x, start, end, 180)), lambda c: _sponsored(c, cfg))


def sponsor_near(folded: Column, start: Column, end: Column, cfg: DetectionConfig) -> Column:
    """D4 on a folded text."""
    return let(context(folded, start, end, 180), lambda c: _sponsored(c, cfg))


def _sponsored(c: Column, cfg: DetectionConfig) -> Column:
    hits = sum((F.contains(c, F.lit(fold_py(w))).cast("int") for w in cfg.ignored_context if w.strip()), F.lit(0))
    return F.contains(c, F.lit(fixed.SPONSOR_PHRASE)) | (hits >= 2)


def glued_mention(x: Column, start: Column, end: Column) -> Column:
    """D4 - the generic name sits inside a longer word."""
    before = F.when(start > 0, F.substring(x, start, F.lit(1))).otherwise(" ")
    return before.rlike(r"\p{L}") | F.substring(x, end + 1, F.lit(1)).rlike(r"\p{L}")


def brand_context(x: Column, start: Column, end: Column, cfg: DetectionConfig) -> Column:
    """D4 - the generic name is a product brand and no organ is near."""
    return brand_near(fold(x), start, end, cfg)


def brand_near(folded: Column, start: Column, end: Column, cfg: DetectionConfig) -> Column:
    """D4 on a folded text."""
    near = context(folded, start, end, 50)
    wide = context(folded, start, end, 200)
    brand = near.rlike(rf"\bmarca\s*[:\-]?\s*{cfg.key}\b") | near.rlike(rf"\b{cfg.key}\s*\d+\b")
    return brand & ~any_contains(wide, (*fixed.BRAND_OVERRIDE, f"municipio de {cfg.key}"))


def category(x: ColumnLike, cfg: DetectionConfig) -> Column:
    """D7 - sponsor, official publication or news."""
    return let(fold(text(x)), lambda f: category_of(f, cfg))


def category_of(folded: Column, cfg: DetectionConfig) -> Column:
    """D7 on a folded text; the surroundings of its first character tell a sponsor."""
    return (
        F.when(let(F.substring(folded, 1, 181), lambda c: _sponsored(c, cfg)), "patrocinador_distribuicao")
        .when(any_contains(folded, fixed.OFFICIAL_SIGNALS), "publicacao_oficial")
        .otherwise("materia_jornalistica"))


# ---- D15 line predicates -------------------------------------------------------------------


def is_title_line(line: Column) -> Column:
    return fold(line).rlike(fixed.TITLE_LINE)


def has_subject_label(x: Column) -> Column:
    return fold(x).rlike(fixed.SUBJECT_LABEL)


def is_footer_line(line: Column, cfg: DetectionConfig) -> Column:
    return is_footer(head(line, 160), cfg)


def is_footer(folded: Column, cfg: DetectionConfig) -> Column:
    """D15 on a folded, squeezed line."""
    names = "".join(f"|{n}" for n in cfg.named_persons)
    return F.substring(folded, 1, 160).rlike(fixed.FOOTER_LINE.replace("|assinado", names + "|assinado"))


def is_continuation(x: ColumnLike, cfg: DetectionConfig) -> Column:
    names = "".join(f"|{n}" for n in cfg.named_persons)
    return head(x, 140).rlike(fixed.CONTINUATION.replace("|assinado", names + "|assinado"))


def line_starts_act(x: ColumnLike) -> Column:
    """D15 - the first line is an act title (and no mere reference to a law)."""
    first = F.try_element_at(lines_of(x), F.lit(1))

    def test(f: Column) -> Column:
        reference = f.rlike(fixed.LEGAL_REFERENCE) & ~f.rlike(fixed.LEGAL_REFERENCE_KEPT)
        return ~reference & f.rlike(fixed.TITLE_LINE)

    return F.coalesce(let(fold(first), test), F.lit(False))


def has_act_header(x: ColumnLike) -> Column:
    """D15 - any line is a title or carries a subject label."""
    return F.exists(line_rows(lines_of(x)), lambda r: r["title"] | r["label"])


# ---- D8 organ ------------------------------------------------------------------------------


def extract_organ(x: ColumnLike, cfg: DetectionConfig, clean: bool = False) -> Column:
    """D8 - own organ by the head of the text, truncated headers, councils and funds, then the tax id."""
    return let(scanned(x, cfg, clean), lambda n: organ_of(n, fold(n), fold(squeeze(n)), cfg))


def organ_of(n: Column, folded: Column, flat: Column, cfg: DetectionConfig) -> Column:
    """D8 on a normalised text, the folded one, and the folded one in one line."""
    k, t, stem = cfg.key, cfg.target, cfg.stem
    exec_, council = f"Prefeitura Municipal de {t}", f"Câmara Municipal de {t}"

    def rules(flat: Column) -> Column:
        parts = F.struct(n.alias("n"), F.substring(flat, 1, 280).alias("head"), F.substring(flat, 1, 800).alias("full"), folded.alias("whole"))

        def choose(v: Column) -> Column:
            h, full, whole = v["head"], v["full"], v["whole"]
            named = F.contains(whole, F.lit(k))
            other = F.substring(full, 1, 200).rlike(rf"\bprefeitura\s+(municipal\s+)?de\s+(?!{k})\w+")
            out = (
                F.when(h.rlike(fixed.ARTICLE_START), F.lit(None).cast("string"))
                .when(h.rlike(rf"^prefeitura( municipal)?( do municipio)? de {k}\b"), exec_)
                .when(h.rlike(rf"^camara( municipal)? de {k}\b"), council)
                .when(h.rlike(rf"^municipio de {k}\b"), f"Município de {t}")
                .when(h.rlike(rf"^prefeitura\s+municipal\s+de\s+{stem}\b"), exec_)
                .when(h.rlike(rf"^camara\s+municipal\s+de\s+{stem}\b"), council)
                .when(named & full.rlike(rf"\bprefeitura\s+(municipal\s+)?de\s+{k}\b") & ~other, exec_)
                .when(named & full.rlike(rf"\bmunicipio\s+de\s+{k}\b"), f"Município de {t}")
                .when(named & h.rlike(r"^conselho municipal de saude\b"), f"Conselho Municipal de Saúde de {t}")
                .when(named & h.rlike(r"^fundo municipal\b"), f"Fundo Municipal de {t}")
                .when(named & h.rlike(r"^(conselho municipal|comite municipal|comissao municipal)\b"), f"Conselho Municipal de {t}"))
            if cfg.tax_ids:
                out = out.when(F.contains(v["n"], F.lit(cfg.tax_ids[0])), exec_)
            for tax in cfg.tax_ids[1:]:
                is_council = any_contains(whole, ("camara municipal", f"camara de {k}"))
                out = out.when(F.contains(v["n"], F.lit(tax[:15])), F.when(is_council, council).otherwise(f"Município de {t}"))
            return out

        return let(parts, choose)

    return let(flat, rules)


# ---- D9 type and number --------------------------------------------------------------------


def looks_personal(number: Column, line: Column) -> Column:
    """The number belongs to a personal document or a tax registration, not to the act."""
    f = fold(line)
    marked = F.regexp_like(f, F.concat(F.lit(r"n[o°.]?\s*"), F.replace(number, F.lit("."), F.lit("[.]"))))
    return (
        F.when(line.rlike(fixed.PERSONAL_ID), True).when(marked, False)
        .when(F.contains(number, F.lit(".")) & ~F.contains(number, F.lit("/")), True)
        .otherwise(any_contains(f, ("cpf", "rg", "cnpj"))))


def _title_of(row: Column) -> Column:
    """struct(act_type, number) of a (line, folded line) pair that announces an act, else NULL."""
    line, f = row["line"], row["f"]
    facts = F.struct(
        line.alias("line"), f.alias("f"), F.regexp_extract(f, fixed.TITLE_TYPE_NUMBER, 0).alias("m0"),
        F.regexp_extract(f, fixed.TITLE_TYPE_NUMBER, 1).alias("m1"),
        F.nullif(F.regexp_extract(f, fixed.TITLE_TYPE_NUMBER, 2), F.lit("")).alias("num"), f.rlike(fixed.TITLE_LINE).alias("title"),
        f.rlike(fixed.TYPE_WITH_MARK).alias("marked"), f.rlike(fixed.LEGAL_REFERENCE).alias("legal"), F.contains(f, F.lit("n")).alias("sign"))

    def decide(v: Column) -> Column:
        m1, legal, sign, plain = v["m1"], v["legal"], v["sign"], ~v["title"] & ~v["marked"]
        raw = F.substring(v["line"], F.instr(v["f"], v["m0"]) + F.instr(v["m0"], m1) - 1, F.length(m1))

        def has(w: str) -> Column:
            return F.contains(m1, F.lit(w))

        label = (
            F.when(has("termo") & has("aditivo"), "Termo Aditivo").when(has("extrato") & has("contrato"), "Extrato de Contrato")
            .when(has("dispensa"), "Dispensa").when(has("homolog"), "Homologação/Adjudicação").when(has("pregao"), "Pregão")
            .otherwise(title_case(squeeze(raw))))
        skip = (
            (legal & plain) | (plain & ~v["f"].rlike(fixed.ACT_HINT)) | ((m1 == "lei") & (legal | ~sign))
            | (legal & ~sign & ~(has("aditivo") | has("extrato") | has("dispensa"))))
        personal = F.coalesce(looks_personal(v["num"], v["line"]), F.lit(False))
        kept = F.when(v["num"].isNotNull(), F.when(~personal, normalize_act_number(v["num"])))
        return F.when(~skip, F.struct(label.alias("act_type"), kept.alias("number")))

    return let(facts, decide)


def extract_type_number(x: ColumnLike, cfg: DetectionConfig, clean: bool = False) -> Column:
    """D9 - struct(act_type, number) of the first line that announces an act; the first three lines are also tried
    as one line, since scans break titles."""
    def folded(lines: Column) -> Column:
        return F.transform(lines, lambda s: F.struct(s.alias("s"), fold(s).alias("f")))

    return let(folded(lines_of(scanned(x, cfg, clean))), type_number_of)


def type_number_of(rows: Column) -> Column:
    """D9 on the lines of a text (see `line_rows`). Lines are read up to the first that announces an act."""
    def pair(s: Column, f: Column) -> Column:
        return F.struct(s.alias("line"), f.alias("f"))

    first = F.slice(rows, 1, 3)
    joined = F.when(F.size(rows) > 0, F.array(pair(F.array_join(F.transform(first, lambda r: r["s"]), " "), F.array_join(F.transform(first, lambda r: r["f"]), " "))))
    every = F.concat(F.transform(rows, lambda r: pair(r["s"], r["f"])), F.coalesce(joined, F.array().cast("array<struct<line:string,f:string>>")))
    none = F.lit(None).cast("struct<act_type:string,number:string>")
    return F.aggregate(every, none, lambda found, r: F.when(found.isNotNull(), found).when(r["f"].rlike(fixed.TITLE_TYPE), _title_of(r)))


# ---- D10 / D11 numbers ---------------------------------------------------------------------


def marked_numbers(folded: Column) -> Column:
    """D10 - all numbers behind a number sign in a folded text, parts joined by slashes. One fixed pattern finds them all."""
    found = F.regexp_extract_all(folded, F.lit(r"n(?:[o°.]?\s*|umero\s*[:\s]*)(?=(\d+(?:\s*[/\-.]\s*\d+)*)\b)"), F.lit(1))
    return F.transform(found, lambda s: F.regexp_replace(s, r"\s*[/\-.]\s*", "/"))


def number_anchored(number: ColumnLike, x: ColumnLike) -> Column:
    """D10 - the number stands behind a number sign in the text, whole or followed by further parts. Numbers of other
    characters than digits and slashes, which are rare, are searched for as patterns."""
    def anchored(n: Column) -> Column:
        f = fold(text(x))
        quoted = F.regexp_replace(F.regexp_replace(n, r"([^a-z0-9/])", r"\\$1"), r"/", r"\\s*[/\\-.]\\s*")
        pattern = F.concat(F.lit(r"(?:n[o°.]?\s*|numero\s*[:\s]*)"), quoted, F.lit(r"\b"))
        among = F.exists(marked_numbers(f), lambda m: (m == n) | F.startswith(m, F.concat(n, F.lit("/"))))
        return (F.length(n) > 0) & (F.length(text(x)) > 0) & F.when(n.rlike(r"^\d+(/\d+)*$"), among).otherwise(F.regexp_like(f, pattern))

    return let(let(text(number), lambda r: fold(F.coalesce(valid_act_number(r), strip(r)))), anchored)


def reliable_number(number: ColumnLike, *texts: ColumnLike) -> Column:
    """D10 - a valid number that is anchored in one of the texts (or has no text to be checked against)."""
    blob = F.array_join(F.filter(F.array(*[text(t) for t in texts]), lambda s: F.length(s) > 0), "\n")
    facts = F.struct(valid_act_number(number).alias("n"), blob.alias("blob"))
    return let(facts, lambda v: F.when(v["n"].isNotNull() & ((F.length(strip(v["blob"])) == 0) | number_anchored(v["n"], v["blob"])), v["n"]))


def preferred_number(x: ColumnLike, act_type: ColumnLike, cfg: DetectionConfig) -> Column:
    """D11 - number from explicit titles: an extract prefers its own title, else the latest year wins. All patterns end in a
    number with its year, so that a text without one is not searched further; each is tried only where its word stands."""
    kind = fold(text(act_type))

    def pick(f: Column) -> Column:
        none = F.array().cast("array<string>")
        groups = [F.when(F.contains(f, F.lit(w)), F.regexp_extract_all(f, F.lit(p), F.lit(1))).otherwise(none) for p, w in zip(fixed.TYPED_NUMBERS, fixed.TYPED_TRIGGERS, strict=True)]
        general = F.regexp_extract_all(f, F.lit(fixed.GENERIC_NUMBER), F.lit(1))
        first = F.when(F.contains(kind, F.lit("aditivo")) & ~F.contains(kind, F.lit("extrato")), F.concat(groups[2], groups[1])).otherwise(none)
        found = F.array_distinct(F.filter(
            F.transform(F.concat(first, *groups, general), lambda s: valid_act_number(F.replace(s, F.lit(" "), F.lit("")))),
            lambda s: s.isNotNull()))

        def best(c: Column) -> Column:
            scored = F.transform(c, lambda s, i: F.struct(
                F.coalesce(F.when(F.contains(s, F.lit("/")), F.substring_index(s, "/", -1).try_cast("int")), F.lit(0)).alias("y"),
                (-i).alias("o"), s.alias("n")))
            own = F.filter(c, lambda s: F.regexp_like(f, F.concat(
                F.lit(r"extrato\s+(?:do\s+|de\s+)?contrato\s+n[o°.]?\s*"), F.substring_index(s, "/", 1))))
            return F.coalesce(F.when(F.contains(kind, F.lit("extrato")), F.try_element_at(own, F.lit(1))), F.array_max(scored)["n"])

        return F.when(f.rlike(fixed.SEQ_YEAR), let(found, best))

    return F.when(F.length(text(x)) > 0, let(fold(normalize_scan(x, cfg)), pick))


# ---- D12-D14 -------------------------------------------------------------------------------


def extract_date(x: ColumnLike, cfg: DetectionConfig, clean: bool = False) -> Column:
    """D12 - first long date, else first numeric date, as written."""
    return let(scanned(x, cfg, clean), lambda t: squeeze(F.coalesce(
        first_match(t, fixed.DATE_LONG), first_match(t, fixed.DATE_NUMERIC))))


def extract_subject(x: ColumnLike, cfg: DetectionConfig, clean: bool = False) -> Column:
    """D13 - subject line of the act (300 characters)."""
    return let(line_rows(lines_of(scanned(x, cfg, clean))), lambda rows: subject_of(rows, cfg))


def subject_of(rows: Column, cfg: DetectionConfig) -> Column:
    """D13 on the lines of a text (see `line_rows`)."""
    label = rx(fixed.SUBJECT_LABEL_RAW)

    def labelled(s: Column) -> Column:
        return F.concat(title_case(F.regexp_extract(s, label, 1)), F.lit(": "), F.trim(F.regexp_extract(s, label, 2)))

    def first(arr: Column) -> Column:
        return F.try_element_at(arr, F.lit(1))["s"]


    def pick(rows: Column, at: Column) -> Column:
        title = F.try_element_at(rows, F.nullif(at, F.lit(0)))
        following = F.slice(rows, at + 1, 4)
        label_next = first(F.filter(following, lambda r: r["label"]))
        plain_next = first(F.filter(following, lambda r: ~r["title"] & ~is_footer(r["f"], cfg)))
        after_title = (
            F.when(title["label"], labelled(title["s"]))
            .when(label_next.isNotNull(), F.concat(title["s"], F.lit(" - "), F.trim(F.regexp_extract(label_next, label, 2))))
            .otherwise(F.coalesce(plain_next, title["s"])))
        anywhere = first(F.filter(rows, lambda r: r["label"]))
        keyword = first(F.filter(rows, lambda r: any_contains(r["f"], fixed.SUBJECT_KEYWORDS)))
        plain = first(F.filter(rows, lambda r: ~is_footer(r["f"], cfg)))
        out = F.when(at > 0, after_title).otherwise(F.coalesce(labelled(anywhere), keyword, plain))
        return F.substring(squeeze(out), 1, 300)

    return let(F.array_position(F.transform(rows, lambda r: r["title"]), True).cast("int"), lambda at: pick(rows, at))


def shorten_subject(x: ColumnLike, cfg: DetectionConfig) -> Column:
    """D13 - repaired subject, cut where the enacting formula begins."""
    def cut(t: Column) -> Column:
        # pieces of the formula's words without the letters (i, k, s) that others match regardless of case
        return F.when(any_contains(F.lower(t), ("mara", "art", "olve")), F.element_at(F.split(t, rx(fixed.SUBJECT_CUT), 2), 1)).otherwise(t)

    s = let(repair_scan(x, cfg), cut)
    s = F.substring(F.regexp_replace(s, r"^[ .,\-]+|[ .,\-]+$", ""), 1, 300)
    return F.nullif(s, F.lit(""))


def extract_value(x: ColumnLike) -> Column:
    """D14 - the amount after 'valor de', else the largest amount (first on ties)."""
    t = text(x)
    labelled = first_match(t, fixed.MONEY_AFTER_LABEL, 1)
    found = F.transform(F.regexp_extract_all(t, F.lit(rx(fixed.MONEY)), F.lit(0)), normalize_money_match)
    largest = F.array_max(F.transform(found, lambda s, i: F.struct(money_amount(s).alias("v"), (-i).alias("o"), s.alias("s"))))["s"]
    return F.when(labelled.isNotNull(), normalize_money_match(labelled)).otherwise(largest)


# ---- D16 foreign entity --------------------------------------------------------------------


def _organ_of(names: str) -> str:
    return (rf"\b(?:prefeitura(?:\s+municipal)?(?:\s+do)?(?:\s+municipio)?|camara(?:\s+municipal)?|municipio|"
            rf"prefeit[oa](?:\s+municipal)?)\s+(?:de\s+)?(?:{names})\b")


def foreign_entity(x: ColumnLike, cfg: DetectionConfig) -> Column:
    """D16 - the text belongs to a neighbour: an organ of the neighbour in the first 600 characters (unless own tax id
    and own organ dominate), or a short header with the neighbour's name."""
    return foreign_of(fold(squeeze(text(x))), has_entity_taxid(x, cfg), cfg)


def foreign_of(flat: Column, own_tax: Column, cfg: DetectionConfig) -> Column:
    """D16 on the folded text in one line."""
    names = cfg.neighbour_keys
    if not names:
        return F.lit(False)
    k = cfg.key

    def test(full: Column) -> Column:
        h600 = F.substring(full, 1, 600)
        own_organ = F.substring(full, 1, 500).rlike(rf"\b(prefeitura|camara|municipio|prefeito)(\s+\w+){{0,4}}\s+{k}\b") | any_contains(
            F.substring(full, 1, 400), (f"prefeitura municipal de {k}", f"camara municipal de {k}", f"municipio de {k}"))
        own = own_tax & own_organ
        dominant = F.lit(False)
        for n in names:
            dominant = dominant | (F.contains(F.substring(full, 1, 120), F.lit(n)) & h600.rlike(_organ_of(n)))
        named = any_contains(h600, names)
        by_organ = named & h600.rlike(_organ_of("|".join(names))) & (~own | dominant)
        short = (
            F.substring(full, 1, 80).rlike("prefeitura|camara|municipio")
            & ~F.contains(F.substring(full, 1, 120), F.lit(k)) & any_contains(F.substring(full, 1, 140), names))
        return by_organ | short

    return let(flat, test)


def suspect_foreign(organ: ColumnLike, excerpt: ColumnLike, cfg: DetectionConfig) -> Column:
    """D16 - post-check of an extracted act: not an own organ, and the excerpt points to a neighbour."""
    return suspect_of(organ, has_entity_taxid(excerpt, cfg), foreign_entity(excerpt, cfg), cfg)


def suspect_of(organ: ColumnLike, own_tax: Column, foreign: Column, cfg: DetectionConfig) -> Column:
    """D16 from what the excerpt tells."""
    o = fold(text(organ))
    return ~F.contains(o, F.lit(cfg.key)) & ~(own_tax & (F.length(o) == 0)) & foreign
