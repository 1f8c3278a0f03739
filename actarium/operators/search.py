"""H1-H13 - candidacy scores, work queues, ranked search, timelines and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..config import DetectionConfig, QualityConfig, fold_py
from ..functions.text import ColumnLike, any_contains, compute_once, count_of, digits, filled, fold, let, text
from ..functions.values import json_object_or_empty
from . import ranking
from .lineage import cut

# ---- H1-H4, H13 queues ---------------------------------------------------------------------


def _signals(n: Column, cfg: DetectionConfig) -> dict[str, Column]:
    """H1 - what a folded text shows; a text has a sign if one of its parts has."""
    key, d = cfg.key, digits(n)
    return {
        "ours": F.contains(n, F.lit(key)), "named": n.rlike(rf"\b{key}\b") | any_contains(n, (f"{key}-pr", f"{key}/pr")),
        "weak": any_contains(n, (key[:-2] + " " + key[-2:], key[:-1] + " " + key[-1:])), "tax": any_contains(d, cfg.tax_roots), "postal": any_contains(d, cfg.postal_prefixes),
        "organ": any_contains(n, fixed.CANDIDACY_ORGANS), "kind": any_contains(n, fixed.CANDIDACY_TYPES), "money": n.rlike(r"r\$\s*[\d.,]+"), "news": any_contains(n, fixed.CANDIDACY_NEWS),
        **{f"near{i}": F.contains(n, F.lit(m)) for i, m in enumerate(cfg.neighbour_keys)}, **{f"hall{i}": F.contains(n, F.lit(f"prefeitura municipal de {m}")) for i, m in enumerate(cfg.neighbour_keys)}}


def _rated(s: Column, cfg: DetectionConfig) -> Column:
    """H1 - score, reasons and priority of a struct of signs."""
    neighbour = F.coalesce(*[F.when(s[f"near{i}"] & ~s["ours"], f"vizinho:{m}").when(s[f"hall{i}"], f"prefeitura vizinha:{m}") for i, m in enumerate(cfg.neighbour_keys)], F.lit(None))
    points = [
        (F.when(s["named"], 35).when(s["weak"], 20), F.when(s["named"], "menciona o alvo").otherwise("possível alvo (leitura fraca)")),
        (F.when(s["tax"], 25), F.lit("CNPJ do alvo")), (F.when(s["postal"], 15), F.lit("CEP do alvo")), (F.when(s["organ"], 20), F.lit("órgão oficial")),
        (F.when(s["kind"], 12), F.lit("tipo de ato")), (F.when(s["money"], 5), F.lit("valor monetário")), (F.when(neighbour.isNotNull(), -40), neighbour),
        (F.when(s["news"] & ~s["ours"], -15), F.lit("possível matéria"))]
    hits = F.filter(F.array(*[F.struct(p.cast("int").alias("p"), r.alias("r")) for p, r in points]), lambda x: x["p"].isNotNull())

    def rate(h: Column) -> Column:
        total = F.aggregate(h, F.lit(0), lambda a, x: a + x["p"])
        return let(F.greatest(F.lit(0), F.least(F.lit(100), total)), lambda v: F.struct(
            v.alias("score"), F.transform(h, lambda x: x["r"]).alias("reasons"), F.when(v >= 55, 0).when(v >= 25, 1).otherwise(2).alias("priority")))

    return let(hits, rate)


def candidacy(title: ColumnLike, body: ColumnLike, cfg: DetectionConfig) -> Column:
    """H1 - struct(score 0-100, reasons, priority 0/1/2): does this look like an official act of the target?"""
    return let(fold(F.concat(text(title), F.lit("\n"), text(body))), lambda n: let(F.struct(*[c.alias(k) for k, c in _signals(n, cfg).items()]), lambda s: _rated(s, cfg)))


def edition_candidacy(editions: DataFrame, pages: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """H1 after reading - edition_id, score, reasons, priority from the title and every page. Signs are found page by page and
    combined before the shuffle, so that no edition is put together."""
    names = list(_signals(F.lit(""), cfg))
    parts = editions.select("edition_id", text("title").alias("_t")).unionByName(pages.join(editions.select("edition_id"), "edition_id", "left_semi").select("edition_id", text("text").alias("_t")))
    n = compute_once(parts, _n=fold("_t"))
    found = compute_once(n, **_signals(F.col("_n"), cfg)).groupBy("edition_id").agg(F.struct(*[F.bool_or(c).alias(c) for c in names]).alias("s"))
    return found.select("edition_id", _rated(F.col("s"), cfg).alias("c")).select("edition_id", "c.*")


def rescore_pending(editions: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """H2 - pending editions get the score of their title; processed ones keep theirs."""
    pending = F.col("processed") == 0
    e = compute_once(editions, _c=F.when(pending, candidacy("title", F.lit(""), cfg)))
    return e.withColumns({"candidacy": F.when(pending, F.col("_c.score")).otherwise(F.col("candidacy")).cast("int"),
                          "priority": F.when(pending, F.col("_c.priority")).otherwise(F.col("priority")).cast("int")}).drop("_c")


def pending_queue(editions: DataFrame, as_of: str, k: int | None = None, recent_days: int | None = None, since: str | None = None,
                  include_quarantine: bool = False, process_all: bool = False, q: QualityConfig = QualityConfig()) -> DataFrame:
    """H3 - editions to process: priority, candidacy, dated first, newest, id. ``recent_days`` keeps undated editions,
    ``since`` drops them."""
    e = editions
    if not process_all:
        e = e.where("processed = 0")
    if recent_days:
        e = e.where(F.col("pub_date").isNull() | (F.col("pub_date") >= F.date_sub(F.lit(as_of).cast("date"), recent_days).cast("string")))
    if since:
        e = e.where(filled("pub_date") & (F.col("pub_date") >= since))
    if not include_quarantine:
        e = e.where(F.coalesce("failures", F.lit(0)) < q.quarantine_failures)
    order = [F.coalesce("priority", F.lit(1)).asc(), F.coalesce("candidacy", F.lit(0)).desc(), F.when(filled("pub_date"), 0).otherwise(1).asc(),
             F.desc_nulls_last("pub_date"), F.desc("edition_id")]
    out = e.orderBy(*order)
    return out.limit(k) if k else out


def agent_pick(editions: DataFrame, k: int, as_of: str, cfg: DetectionConfig, since: str | None = None, q: QualityConfig = QualityConfig()) -> DataFrame:
    """H4 - the k best waiting editions by recency, title and stored file; all of them are scored."""
    e = editions.where((F.col("processed") == 0) & (F.coalesce("failures", F.lit(0)) < q.quarantine_failures))
    if since:
        e = e.where(F.col("pub_date").isNull() | (F.col("pub_date") >= since))
    base = [F.coalesce("priority", F.lit(1)).desc(), F.coalesce("candidacy", F.lit(0)).desc(), F.desc_nulls_last("pub_date"), F.desc("edition_id")]
    age = F.date_diff(F.lit(as_of).cast("date"), F.try_to_date(F.substring(text("pub_date"), 1, 10), "yyyy-MM-dd"))
    score = (
        10 * F.coalesce("priority", F.lit(0)) + F.coalesce("candidacy", F.lit(0)) + F.when(age <= 7, 50).when(age <= 30, 25).when(age <= 120, 10).otherwise(0)
        + F.when(F.contains(fold(text("title")), F.lit(cfg.key)), 40).otherwise(0) + F.when(filled("file_path"), 15).otherwise(0)
        + F.when(filled("file_path") & filled("text_path"), 5).otherwise(0))
    return e.withColumn("pick_score", score.cast("int")).orderBy(F.desc("pick_score"), *base).limit(k)


def select_batch(editions: DataFrame, as_of: str, month: str | None = None, last_days: int | None = None, k: int | None = None, exclude_url: str | None = None,
                 pending_only: bool = False, cached: DataFrame | None = None) -> DataFrame:
    """H13 - work list: a month or the last days, oldest first; or pending ones, newest first; optionally only editions
    whose text file is in ``cached`` (text_path)."""
    e = editions
    if month:
        e = e.where(F.col("pub_date").startswith(month))
    if last_days:
        e = e.where(F.col("pub_date") >= F.date_sub(F.lit(as_of).cast("date"), last_days).cast("string"))
    if exclude_url:
        e = e.where(~F.contains(F.col("url"), F.lit(exclude_url)))
    if cached is not None:
        e = e.where("processed = 1").join(cached.select("text_path").distinct(), "text_path", "left_semi")
    if pending_only:
        e = e.where("processed = 0").orderBy(F.desc_nulls_last("pub_date"), F.desc("edition_id"))
    else:
        e = e.orderBy(F.asc_nulls_first("pub_date"), F.asc("edition_id"))
    return e.limit(k) if k else e


# ---- H5, H8 ranked search ------------------------------------------------------------------

SEARCHED = ("act_type", "number", "organ", "subject", "summary", "excerpt", "value", "edition_title")


def search_text(acts: DataFrame) -> Column:
    return ranking.search_text(acts, SEARCHED)


def boost_tenths(acts: DataFrame) -> Column:
    return (F.when(filled("summary"), 5).otherwise(0) + F.when(filled("value"), 2).otherwise(0)).cast("bigint")


def rank_acts(acts: DataFrame, query_text: str, k: int = 30) -> DataFrame:
    """H5 - one search text: its tokens are literals, so every act is scored in its row and the top k is a
    TakeOrderedAndProject. Score = sum over tokens contained of 3 + 0.3 x occurrences, +0.5 with a summary, +0.2 with a
    value (kept in tenths, so that ties are exact). A token that starts a word is contained too, so the weaker prefix
    rule never applies. Acts without any token but with a boost stay in the ranking."""
    toks: dict[str, int] = {}
    for t in _tokens_py(query_text):
        toks[t] = toks.get(t, 0) + 1
    a = compute_once(acts, _b=search_text(acts))
    score = boost_tenths(acts)
    for t, m in toks.items():
        n = count_of(F.col("_b"), F.lit(t))
        score = score + F.when(n > 0, m * (30 + 3 * n)).otherwise(0)
    s = a.withColumn("_s", score).where("_s > 0").orderBy(F.desc("_s"), F.coalesce("pub_date", F.lit("")), F.desc("act_id")).limit(k)
    return s.withColumn("score", F.round(F.col("_s") / 10.0, 2)).drop("_b", "_s")


def _tokens_py(q: str) -> list[str]:
    import re
    return re.findall(r"[a-z0-9]{2,}", fold_py(q))


def rank_acts_many(acts: DataFrame, queries: DataFrame, k: int = 30) -> DataFrame:
    """H5 for a table of search texts (query_id, query): the k best acts of each, found tile by tile (see `ranking`). A text
    without tokens gets the newest acts."""
    rows = acts.select("act_id", "pub_date", boost_tenths(acts).alias("boost"), search_text(acts).alias("blob"))
    return ranking.rank_many(rows, queries, k).select("query_id", "rank", "act_id", F.round(F.col("s") / 10.0, 2).alias("score"))


def similar_query(act_type: ColumnLike = "act_type", organ: ColumnLike = "organ", subject: ColumnLike = "subject", summary: ColumnLike = "summary",
                  themes: ColumnLike = "themes") -> Column:
    """H8 - search text of an act."""
    parts = [text(act_type), text(organ), F.coalesce(F.nullif(text(subject), F.lit("")), text(summary)), text(themes)]
    return F.array_join(F.filter(F.array(*parts), lambda p: F.length(p) > 0), " ")


def similar_acts(acts: DataFrame, targets: DataFrame, k: int = 6) -> DataFrame:
    """H8 - the k acts most like each target, the target itself left out. Targets with one search text are ranked once."""
    asked = cut(targets.select(F.col("act_id").alias("target_id"), similar_query().alias("query")))
    texts = asked.groupBy("query").agg(F.min("target_id").alias("query_id"))
    found = rank_acts_many(acts, texts, k + 1).join(texts, "query_id").drop("query_id")
    r = asked.join(found, "query").where("act_id != target_id")
    w = Window.partitionBy("target_id").orderBy("rank")
    return r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("target_id").alias("query_id"), "rank", "act_id", "score")


# ---- H6, H7, H9-H12 ------------------------------------------------------------------------


def with_edition(acts: DataFrame, editions: DataFrame) -> DataFrame:
    return acts.join(editions.select("edition_id", F.col("title").alias("edition_title"), "pub_date", "url", "has_target"), "edition_id")


def _like(c: str, term: str) -> Column:
    return F.contains(F.lower(text(c)), F.lit(term.lower()))


def newest_first(df: DataFrame, k: int | None = None) -> DataFrame:
    out = df.orderBy(F.desc_nulls_last("pub_date"), F.desc("act_id"))
    return out.limit(k) if k else out


def filter_acts(acts: DataFrame, editions: DataFrame, q: str = "", month: str = "", act_type: str = "", level: str = "", organ: str = "", type_like: str = "",
                since: str = "", until: str = "", only_target: bool = False, k: int | None = None) -> DataFrame:
    """H6 - filtered listing; only the given filters are applied, those on one side are pushed below the join."""
    j = with_edition(acts, editions)
    if q:
        hit = F.lit(False)
        for c in ("edition_title", "pub_date", "organ", "act_type", "subject", "summary", "number"):
            hit = hit | _like(c, q)
        j = j.where(hit)
    if month:
        j = j.where(F.col("pub_date").startswith(month[:7]))
    if act_type:
        j = j.where(F.lower(text("act_type")) == act_type.lower())
    if level:
        j = j.where(F.lower(text("confidence_level")) == level)
    if organ:
        j = j.where(_like("organ", organ))
    if type_like:
        j = j.where(_like("act_type", type_like))
    if since:
        j = j.where(F.col("pub_date") >= since)
    if until:
        j = j.where(F.col("pub_date") <= until)
    if only_target:
        j = j.where("has_target = 1")
    return newest_first(j, k)


def global_search(acts: DataFrame, editions: DataFrame, q: str) -> DataFrame:
    """H7 - five editions and ten acts for the overlay search."""
    e = editions.where((F.col("processed") == 1) & (_like("title", q) | _like("pub_date", q))).orderBy(F.desc_nulls_last("pub_date"), F.desc("edition_id")).limit(5)
    a = acts.where(_like("act_type", q) | _like("organ", q) | _like("subject", q) | _like("number", q)).orderBy(F.desc("act_id")).limit(10)
    return e.select(F.lit("edition").alias("kind"), F.col("edition_id").alias("id"), F.col("title").alias("label")).unionByName(
        a.select(F.lit("act").alias("kind"), F.col("act_id").alias("id"), F.concat_ws(" ", "act_type", "number", "subject").alias("label")))


def _grams(x: Column, size: int) -> Column:
    """Distinct stretches of `size` letters."""
    return F.when(F.length(x) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - size + 1), lambda i: x.substr(i, F.lit(size))))).otherwise(
        F.array().cast("array<string>"))


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text) of all texts that contain a needle; both tables hold their strings once, needles are not empty.

    A needle meets the texts by its rarest stretch of three letters (or of its own length, if shorter) only: the stretches
    of all texts are counted first."""
    held = texts.select("text", F.explode(F.concat(*(_grams(F.col("text"), n) for n in (1, 2, 3)))).alias("gram"))
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    n = F.length("needle")
    own = needles.select("needle", F.explode(F.when(n == 1, _grams(F.col("needle"), 1)).when(n == 2, _grams(F.col("needle"), 2)).otherwise(_grams(F.col("needle"), 3))).alias("gram"))
    rarest = own.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).where("least.n > 0")
    return rarest.select("needle", F.col("least.gram").alias("gram")).join(held, "gram").where(F.contains("text", "needle")).select("needle", "text")


def act_timeline(acts: DataFrame, editions: DataFrame, targets: DataFrame, k: int = 12) -> DataFrame:
    """H9 - related acts of each target in order of time: same number, else acts of the contract chain whose organ contains
    the target's.

    What a target gets depends on its number or organ alone, so the first k + 1 acts are ranked once per number and per
    organ (the limit is applied before the shuffle), and the targets meet these short lists."""
    earliest = [F.asc_nulls_first("pub_date"), F.asc("act_id")]

    def first(df: DataFrame, key: str, n: int) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*earliest))).where(F.col("rank") <= n).drop("rank")

    found = ["act_id", "edition_id", "pub_date"]
    a = acts.select("act_id", "edition_id", F.lower(F.trim(text("number"))).alias("key"), any_contains(fold(text("act_type")), fixed.CHAIN_TYPES).alias("chain"),
                    F.lower(text("organ")).alias("text")).join(editions.select("edition_id", "pub_date"), "edition_id")
    t = targets.select(F.col("act_id").alias("target_id"), F.lower(F.trim(text("number"))).alias("key"), fold(text("act_type")).alias("type"),
                       F.lower(F.substring(text("organ"), 1, 40)).alias("needle"))
    by_number = t.where("key != ''").join(first(a.where("key != ''"), "key", k + 1).select("key", *found), "key")
    loose = t.where("key = '' and type != ''").select("target_id", "needle")
    chain = a.where("chain").select("text", *found)
    lists = first(chain, "text", k + 1)
    pairs = containing(loose.where("needle != ''").select("needle").distinct(), lists.select("text").distinct())
    per_needle = first(pairs.join(lists, "text").drop("text"), "needle", k + 1)
    anywhere = chain.orderBy(*earliest).limit(k + 1).select(F.lit("").alias("needle"), *found)
    by_chain = loose.join(per_needle.select("needle", *found).unionByName(anywhere), "needle")
    j = by_number.select("target_id", *found).unionByName(by_chain.select("target_id", *found)).where("act_id != target_id")
    w = Window.partitionBy("target_id").orderBy(*earliest)
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def latest_acts(acts: DataFrame, editions: DataFrame, k: int = 15, month: str = "", min_importance: int = 0) -> DataFrame:
    """H10 - newest acts."""
    a = acts.where(F.coalesce("importance", F.lit(0)) >= min_importance) if min_importance else acts
    j = with_edition(a, editions)
    return newest_first(j.where(F.col("pub_date").startswith(month)) if month else j, k)


def month_mentions(mentions: DataFrame, editions: DataFrame, month: str, k: int | None = None) -> DataFrame:
    """H11 - mentions of a month by date, page and id."""
    e = editions.where(F.col("pub_date").startswith(month)).select("edition_id", "pub_date", "title")
    j = mentions.join(e, "edition_id").orderBy("pub_date", "page", "mention_id")
    return j.limit(k) if k else j


def act_with_edition(acts: DataFrame, editions: DataFrame) -> DataFrame:
    """H12 - acts with their edition and parsed validation; filter it by act_id (or edition_id) for a lookup."""
    j = with_edition(acts, editions)
    v = json_object_or_empty("validation")
    return j.withColumn("validation_ok", F.get_json_object(v, "$.ok") == "true")


