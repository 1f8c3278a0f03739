"""Personal data: fixed rules, and identifiers found from contexts by bootstrapping. DataFrame functions only.

Rules find e-mail addresses, IP addresses, card and phone numbers. Their entities are the seeds: words that look like
identifiers (see `_CANDIDATE`) stand in a graph of lexical patterns (the word or key before them, the word after them) and
instances (their strings). In each round, a pattern's confidence is the smoothed mean score of its instances, and the score
of an instance that is no seed is the noisy-or of its patterns. Instances of patterns that are confident and well supported
are identifiers too, of kind `id`; entities of the rules always stay.

Texts are read once; what is joined and shuffled are the candidates alone, and sums per pattern and instance are taken before
each shuffle, so that a word that precedes a third of all candidates is no burden.

Spans count code points, the end is exclusive. Defined results: null counts as the empty text, which holds nothing; every row
gives a row, repeated rows alike; a null id is an id like others; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ranked, written

#: In the order in which spans of one start are listed. Possessive forms and starts at the edge of a run take the same
#: matches as the plain rules, in linear time.
KINDS = ("email", "ip", "card", "phone", "id")
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_W, _NOT_W = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
#: A word with a digit or an at sign.
_CANDIDATE = rf"(?<!{_W})[^\x20\x09-\x0D0-9@]*+[0-9@]{_W}*+"
_CORE = r"^(?:.*[=:])?[\"'(\[{<]*(.*?)[\]\"')}>.,;:!?]*$"
_CHUNK = 256


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def matches(text: Column, pattern: str) -> Column:
    """Matches of a pattern from left to right: array of (value, start, end, before, after), where before and after are the
    texts up to the neighbouring matches. Positions are added up in chunks, so that long lists stay cheap."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def placed(x: Column) -> Column:
        m, p = x["m"], x["p"]
        sizes = F.transform(m, lambda v, i: F.struct(F.char_length(F.get(p, i)).alias("gap"), F.char_length(v).alias("size")))
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / _CHUNK).cast("int")), lambda c: F.slice(sizes, c * _CHUNK + 1, F.lit(_CHUNK)))
        totals = F.transform(chunks, lambda c: _sum(F.transform(c, lambda s: s["gap"] + s["size"])))
        empty = F.array().cast("array<struct<start:int,end:int>>")
        ends = F.flatten(F.transform(chunks, lambda c, i: F.aggregate(
            c, F.struct(_sum(F.slice(totals, F.lit(1), i)).alias("at"), empty.alias("spans")),
            lambda a, s: F.struct((a["at"] + s["gap"] + s["size"]).alias("at"), F.concat(a["spans"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), (a["at"] + s["gap"] + s["size"]).alias("end")))).alias("spans")))["spans"]))
        return F.transform(F.array(ends), lambda e: F.transform(m, lambda v, i: F.struct(
            v.alias("value"), F.get(e, i)["start"].alias("start"), F.get(e, i)["end"].alias("end"), F.get(p, i).alias("before"), F.get(p, i + 1).alias("after"))))[0]

    none = F.array().cast("array<struct<value:string,start:int,end:int,before:string,after:string>>")
    return F.transform(F.array(found), lambda x: F.when(F.size(x["m"]) == 0, none).otherwise(placed(x)))[0]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.array(digits.substr(i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)), lambda d: F.when(d > 9, d - 9).otherwise(d))[0])
    return _sum(values) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0"))), lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.when(F.char_length(_digits(value)).between(12, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(_digits(value)).between(9, 15)
    return F.lit(True)


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))


def _entities(text: Column, kind: str, rule: str) -> Column:
    return F.transform(F.filter(matches(text, rule), lambda m: _valid(kind, m["value"])), lambda m: _span(kind, m["start"], m["end"]))


def _count(kind: int) -> Column:
    return F.size(F.filter("all_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found_by_rules(docs: DataFrame) -> DataFrame:
    """doc_id, rank, mark, base (spans in order) and words (candidates: value, start, end, left and right pattern)."""
    text = F.col("text")
    hinted = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    digit = text.rlike("[0-9]")
    rows = ranked(docs).withColumn("digit", digit)
    for kind, rule in RULES.items():
        hint = hinted.get(kind, F.lit(True)) & (F.lit(True) if kind == "email" else F.col("digit"))
        rows = rows.withColumn(kind, F.when(hint, _entities(text, kind, rule)).otherwise(F.array().cast(_SPANS)))
    words = F.when(F.col("digit") | hinted["email"], matches(text, _CANDIDATE)).otherwise(F.array().cast("array<struct<value:string,start:int,end:int,before:string,after:string>>"))
    rows = rows.select("doc_id", "rank", "mark", F.array_sort(F.concat(*RULES)).alias("base"), words.alias("found"))
    found = F.col("found")

    def candidate(m: Column, i: Column) -> Column:
        core, key = F.regexp_extract(m["value"], _CORE, 1), F.regexp_extract(m["value"], r"^(.*[=:])", 1)
        near = F.when(m["before"].rlike(_W), F.regexp_extract(m["before"], rf"({_W}+){_NOT_W}+$", 1)).otherwise(F.coalesce(F.get(found, i - 1)["value"], F.lit("")))
        left = F.when(key != "", key).otherwise(near)
        right = F.when(m["after"].rlike(_W), F.regexp_extract(m["after"], rf"^{_NOT_W}+({_W}+)", 1)).otherwise(F.coalesce(F.get(found, i + 1)["value"], F.lit("")))
        start = m["start"] + F.char_length(m["value"]) - F.char_length(F.regexp_extract(m["value"], r"^(?:.*[=:])?[\"'(\[{<]*(.*)$", 1))
        return F.struct(core.alias("value"), start.alias("start"), (start + F.char_length(core)).alias("end"), F.lower(left).alias("left"), F.lower(right).alias("right"))

    return rows.select("doc_id", "rank", "mark", "base", F.filter(F.transform(found, candidate), lambda w: (
        (F.char_length(w["value"]) >= 6) & (F.contains(w["value"], F.lit("@")) | (F.char_length(_digits(w["value"])) >= 3)))).alias("words"))


def discovered(rows: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.9) -> DataFrame:
    """(rank, mark, start, end) of the candidates outside the base spans that confident patterns hold."""
    w = rows.where(F.size("words") > 0).select("rank", "mark", "base", F.explode("words").alias("w")).select(
        "rank", "mark", "w.*", F.exists("base", lambda b: (b["start"] < F.col("w.end")) & (b["end"] > F.col("w.start"))).alias("seed"))
    both = w.select("rank", "mark", "start", "end", "value", "seed", F.explode(F.array(F.concat(F.lit("<"), "left"), F.concat(F.lit(">"), "right"))).alias("pattern")).where(F.length("pattern") > 1)
    both = written(both, "candidates")
    edges = written(both.groupBy("pattern", "value").agg(F.max("seed").alias("seed")).select("pattern", "value", F.col("seed").cast("double").alias("score"), "seed"), "edges")
    for k in range(rounds):
        patterns = edges.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("sure"), F.count("*").alias("n"))
        if k == rounds - 1:
            break
        shared = edges.join(patterns.where(F.col("n") >= support), "pattern", "left")
        scores = shared.groupBy("value").agg(F.max("seed").alias("is_seed"), (1 - F.exp(F.sum(F.log(1 - 0.9 * F.coalesce("sure", F.lit(0.0)))))).alias("new"))
        scores = scores.select("value", F.when(F.col("is_seed"), F.lit(1.0)).otherwise(F.col("new")).alias("score"))
        edges = written(edges.select("pattern", "value", "seed").join(scores, "value").select("pattern", "value", "score", "seed"), f"edges-{k}")
    good = patterns.where((F.col("n") >= support) & (F.col("sure") >= confidence)).select("pattern")
    return both.where("not seed").join(good, "pattern").select("rank", "mark", "start", "end").distinct()


def personal_data(docs: DataFrame, **bootstrap) -> DataFrame:
    """doc_id, rank, mark, n_email, n_ip, n_card, n_phone, n_id, base (spans), all_spans, base_sha256 and spans of every row."""
    rows = written(found_by_rules(docs), "personal-data")
    more = discovered(rows, **bootstrap).groupBy("rank", "mark").agg(F.collect_list(_span("id", F.col("start"), F.col("end"))).alias("more"))
    r = rows.drop("words").join(more, ["rank", "mark"], "left")
    r = r.withColumn("all_spans", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPANS)))))
    return r.select("doc_id", "rank", "mark", *(_count(k) for k in range(len(KINDS))), "base", "all_spans", F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all_spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans, the first one names the whole."""
    none = F.array().cast(_SPANS)
    merged = F.aggregate(spans, none, lambda a, s: F.when((F.size(a) > 0) & (s["start"] < F.get(a, F.size(a) - 1)["end"]), F.concat(
        F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.get(a, F.size(a) - 1)["start"].alias("start"), F.get(a, F.size(a) - 1)["kind"].alias("kind"), F.greatest(F.get(a, F.size(a) - 1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(a, F.array(s))))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def cut(m: Column) -> Column:
        parts = F.transform(m, lambda s, i: F.concat(text.substr(F.coalesce(F.get(m, i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(m, i - 1)["end"], F.lit(0))), F.get(names, s["kind"])))
        return F.concat(F.array_join(parts, ""), text.substr(F.get(m, F.size(m) - 1)["end"] + 1, F.char_length(text)))

    return F.when(F.coalesce(F.size(spans), F.lit(0)) == 0, text).otherwise(F.transform(F.array(merged), cut)[0])
