"""Quality rules: exact text statistics, and robust multivariate outliers per language and source.

Base rules look at each text alone. The verdict for the rest comes from minimum-covariance-determinant estimates: for every
(lang, source) the centre and covariance of the tightest share of its rows, found by concentration steps from a robust
start, and a limit on the scaled Mahalanobis distance of the transformed statistics. DataFrame functions only; each step
is a partial aggregate over a narrow table of statistics, so that one source with most of the rows needs no special care.

The same estimates are made for every language, and for all rows: a row is judged by its (lang, source) if that has at least
`min_group` passing rows, else by its language, if that has, else by all rows. So every passing row has a verdict, whatever
the size of its source.

Defined results: a null or empty text has no words and fails the base rules; null lang or source form groups of their own;
repeated rows are judged as rows; all columns but doc_id, text, lang and source are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

_SPACES = " \t\n\x0b\f\r"
_SPLIT = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"
#: Statistics after their transformation, and the least spread that each is given.
DIMENSIONS = {"log_words": 0.3, "log_word_length": 0.05, "symbol_share": 0.02, "repeat_share": 0.15}
#: Median of the chi-square distribution with four degrees of freedom.
_CHI2_MEDIAN = 3.3567


def _repeat_words(hashes: Column, repeated: Column) -> Column:
    """Words in a window that occurs twice or more. A few repeated hashes are looked up one by one; of many, equal
    windows are brought side by side by sorting. Of two neighbouring marked windows, what they share counts once."""
    def beside(s):
        return F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    many = F.sort_array(F.transform(F.transform(F.array(pairs), beside)[0], lambda x: x["i"]))
    few = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(repeated, h), i)), lambda x: x.isNotNull())
    places = F.when(F.size(repeated) <= 64, few).otherwise(many)
    return F.transform(F.array(places), lambda p: 3 * F.size(p) - F.aggregate(
        F.transform(p, lambda x, i: F.when(i > 0, F.greatest(F.lit(0), 3 - (x - F.get(p, i - 1)))).otherwise(0)), F.lit(0), lambda a, b: a + b))[0]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row. Equal windows are
    found by their 64-bit hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.char_length(F.regexp_replace(text, f"[^{_SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "").alias("lines"),
        F.btrim(text, F.lit(_SPACES)).alias("text"))
    d = d.select("doc_id", "mark", "lang", "source", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.when(F.col("text") != "", F.split("text", _SPLIT)).otherwise(F.array().cast("array<string>")).alias("words"))
    d = d.select("doc_id", "mark", "lang", "source", "n_symbols", "n_dup_lines", F.size("words").cast("long").alias("n_words"),
                 F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    h = F.col("h")
    pairs = F.zip_with(h, F.slice(h, 2, F.size(h)), lambda a, b: F.xxhash64(a, b))
    d = d.select("doc_id", "mark", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                 F.slice(F.zip_with(pairs, F.slice(h, 3, F.size(h)), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(h) - 2, F.lit(0))).alias("windows"))
    counts = ("doc_id", "mark", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines")
    ordered = F.col("ordered")
    d = d.select(*counts, "windows", F.sort_array("windows").alias("ordered"))
    d = d.select(*counts, "windows", F.array_distinct(F.filter(ordered, lambda x, i: F.get(ordered, i - 1) == x)).alias("repeated"))
    return d.select(*counts, F.when(F.size("repeated") == 0, 0).otherwise(_repeat_words(F.col("windows"), F.col("repeated"))).cast("long").alias("n_repeat_words"))


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def _vector() -> list[Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    values = (F.log(words), F.log(chars / words), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_repeat_words") / words))
    return [v.alias(n) for v, n in zip(values, DIMENSIONS, strict=True)]


def _with_distance(rows: DataFrame) -> DataFrame:
    d = len(DIMENSIONS)
    out = rows
    for i, name in enumerate(DIMENSIONS):
        rest = F.col(name) - F.col("m")[i]
        for j in range(i):
            rest = rest - F.col("c")[i * d + j] * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", rest / F.col("c")[i * d + i])
    total = reduce(lambda a, b: a + b, (F.col(f"y{i}") * F.col(f"y{i}") for i in range(d)))
    return out.withColumn("distance", total).drop(*(f"y{i}" for i in range(d)))


def _factor(groups: DataFrame) -> DataFrame:
    """Cholesky factor `c` of each group's covariance (columns s_i_j), with the least spreads added to its diagonal."""
    d, floors = len(DIMENSIONS), list(DIMENSIONS.values())
    for i in range(d):
        for j in range(i + 1):
            rest = F.col(f"s_{i}_{j}") + (F.lit(floors[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"c_{i}_{k}") * F.col(f"c_{j}_{k}")
            groups = groups.withColumn(f"c_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(floors[i] ** 2 / 100))) if i == j else rest / F.col(f"c_{j}_{j}"))
    cells = [F.col(f"c_{i}_{j}") if j <= i else F.lit(0.0) for i in range(d) for j in range(d)]
    return groups.select("group", "m", F.array(*cells).alias("c"))


def _groups() -> Column:
    """The groups of a row from the narrowest to all rows; nulls have groups of their own."""
    lang, source = (F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in ("lang", "source"))
    return F.array(F.concat(F.lit("2"), F.length(lang), lang, source), F.concat(F.lit("1"), lang), F.lit("0"))


def _start(rows: DataFrame, min_group: int) -> DataFrame:
    """Medians, and spreads from quartiles, without correlation; for groups of some size, and for all rows."""
    names = list(DIMENSIONS)
    q = rows.groupBy("group").agg(F.count("*").alias("n"), *(F.percentile_approx(n, [0.25, 0.5, 0.75], 1000).alias(n) for n in names))
    q = q.where((F.col("n") >= min_group) | (F.col("group") == "0"))
    q = q.withColumn("m", F.array(*(F.col(n)[1] for n in names)))
    for i, n in enumerate(names):
        for j in range(i + 1):
            q = q.withColumn(f"s_{i}_{j}", F.pow((F.col(n)[2] - F.col(n)[0]) / 1.349, 2) if i == j else F.lit(0.0))
    return _factor(q)


def _concentrated(rows: DataFrame, groups: DataFrame, share: float) -> DataFrame:
    """One concentration step: mean and covariance of the rows of least distance."""
    names = list(DIMENSIONS)
    near = _with_distance(rows.join(groups, "group"))
    # written, so that its small size is known and the rows are not dealt by their group to meet it
    limits = written(near.groupBy("group", "m").agg(F.percentile_approx("distance", share, 10000).alias("limit")), "mcd-limits")
    near = near.drop("m").join(limits, "group").where("distance <= limit")
    # products are taken about the previous centre, which keeps the sums small
    shifted = [F.col(n) - F.col("m")[i] for i, n in enumerate(names)]
    sums = near.groupBy("group").agg(
        F.first("m").alias("old"), *(F.avg(x).alias(f"a_{i}") for i, x in enumerate(shifted)),
        *(F.avg(shifted[i] * shifted[j]).alias(f"p_{i}_{j}") for i in range(len(names)) for j in range(i + 1)))
    sums = sums.withColumn("m", F.array(*(F.col("old")[i] + F.col(f"a_{i}") for i in range(len(names)))))
    for i in range(len(names)):
        for j in range(i + 1):
            sums = sums.withColumn(f"s_{i}_{j}", F.col(f"p_{i}_{j}") - F.col(f"a_{i}") * F.col(f"a_{j}"))
    return _factor(sums)


def outliers(stats: DataFrame, share: float = 0.75, steps: int = 3, min_group: int = 40, cutoff: float = 200.0) -> DataFrame:
    """Statistics with base_failed, distance (null where the base rules fail) and kept. `stats` is read several times and should be a table.

    share: part of a group's rows that its estimate rests on; min_group: rows from which a group is judged by its own
    estimate; cutoff: limit on the squared distance, scaled so that the group's median is that of a normal distribution."""
    rows = stats.select("*", base_failed().alias("base_failed"), *_vector())
    # a narrow table, which the steps read; rows meet only the written estimates, never each other
    good = written(rows.where("not base_failed").select(F.explode(_groups()).alias("group"), *DIMENSIONS), "mcd-rows")
    groups = written(_start(good, min_group), "mcd-0")
    for step in range(steps):
        groups = written(_concentrated(good, groups, share), f"mcd-{step + 1}")
    scale = _with_distance(good.join(groups, "group")).groupBy("group").agg(F.greatest(F.percentile_approx("distance", 0.5, 10000), F.lit(1e-9)).alias("middle"))
    final = written(groups.join(scale, "group"), "mcd-scaled")
    # the group that judges each combination of language and source: the narrowest one that has an estimate
    kinds = stats.select("lang", "source").distinct().select("lang", "source", F.explode(_groups()).alias("group"))
    judge = kinds.join(final, "group").groupBy("lang", "source").agg(F.max_by(F.struct("m", "c", "middle"), "group").alias("g")).select(
        F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "g.*")
    judged = rows.join(judge, rows["lang"].eqNullSafe(judge["g_lang"]) & rows["source"].eqNullSafe(judge["g_source"]), "left").drop("g_lang", "g_source")
    judged = _with_distance(judged).withColumn("distance", F.when(~F.col("base_failed"), F.col("distance") * _CHI2_MEDIAN / F.col("middle")))
    return judged.select(*stats.columns, "base_failed", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"))


def quality(docs: DataFrame, **limits) -> DataFrame:
    """Statistics and verdict of every document."""
    return outliers(written(statistics(docs), "statistics"), **limits)
