"""Work that grows with the tables: rows dealt to tasks, streams in few batches, tiles of the search, records of the mirror."""

import datetime as dt
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from actarium.functions.text import _triggered_rules, fold, has_entity_taxid, normalize_scan, squeeze
from actarium.operators import detection as D
from actarium.operators import extraction as X
from actarium.operators import ranking as R
from actarium.plans import catalog
from actarium.plans.registry import QUERIES, Tables
from actarium.sources import store as S


@pytest.fixture
def small(spark, tmp_path):
    """Tables of few rows, each a single file of one row group (lineitem: three files)."""
    day = dt.datetime(1996, 3, 1)
    spark.createDataFrame([(i, i % 3, day + dt.timedelta(i % 4), ("1-URGENT", "2-HIGH", "5-LOW")[i % 3], "OPF"[i % 3], 1000.0 + i) for i in range(60)],
                          "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string, o_orderstatus string, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, f"Customer#{i}", i, "BUILDING") for i in range(3)], "c_custkey long, c_name string, c_nationkey long, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i, f"NATION_{i}") for i in range(3)], "n_nationkey long, n_name string").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(i, i, i % 5, i % 4, float(i % 9), "ANR"[i % 3], "FO"[i % 2], day + dt.timedelta(i % 2)) for i in range(90)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp").repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.fixture
def undealt(spark):
    """The session does not name a number of parts, as on a cluster."""
    named = spark.conf.get("spark.actarium.spread")
    spark.conf.unset("spark.actarium.spread")
    yield
    spark.conf.set("spark.actarium.spread", named)


def test_rows_of_one_split_are_dealt_to_all_cores(spark, small, undealt):
    t = Tables(spark, small)
    assert t.orders.rdd.getNumPartitions() == 1
    assert t.spread("gz_pages").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(t.spread("gz_pages").collect()) == sorted(t.gz_pages.collect())


@pytest.mark.parametrize("name", ["K2_stream_detect", "K10_stream_mentions_once"])
def test_stream_takes_a_delivery_in_a_batch(spark, small, undealt, tmp_path, monkeypatch, name):
    catalog.load()
    monkeypatch.setattr(Tables, "scratch", lambda self, what: f"{tmp_path}/scratch/{what}")
    spark.conf.set("spark.actarium.spread", "12")
    QUERIES[name](Tables(spark, small)).count()
    for folder in [f for f in (tmp_path / "scratch" / "ckpt").rglob("offsets")]:
        assert len([f for f in folder.iterdir() if f.name.isdigit()]) <= 4


def test_tile_ranks_some_queries_at_a_time(monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)] + ["de", "dede", "rara"]
    blobs = [" ".join(rng.choice(words, 6, p=[.06] * 12 + [.13, .13, .02])) for _ in range(80)]
    boosts, days, ids = rng.integers(0, 3, 80), rng.integers(0, 4, 80), rng.permutation(80).astype(np.int64)
    queries = [Counter(str(w) for w in rng.choice(words, 3)) for _ in range(9)]
    monkeypatch.setattr(R, "_SCORES", 200, raising=True)
    got = {}
    for q, a, s in zip(*R.best_of_tile(blobs, boosts, days, ids, queries, 5)):
        got.setdefault(int(q), []).append((int(ids[a]), int(s)))
    for q, tokens in enumerate(queries):
        score = [int(boosts[i]) + sum(m * (30 + 3 * b.count(t)) for t, m in tokens.items() if t in b) for i, b in enumerate(blobs)]
        best = sorted((i for i in range(80) if score[i]), key=lambda i: (-score[i], days[i], -ids[i]))[:5]
        assert sorted(got.get(q, [])) == sorted((int(ids[i]), score[i]) for i in best)


@pytest.mark.parametrize("k, blank", [(7, 0), (40, 3)])
def test_tile_adds_shared_tokens_once(monkeypatch, k, blank):
    rng = np.random.default_rng(8)
    words = ["de", "dede", "obra", "lei", *(f"r{i}" for i in range(40))]
    odds = np.array([.2, .1, .2, .1] + [.01] * 40)
    blobs = [" ".join(rng.choice(words, 8, p=odds)) for _ in range(1500)] + ["obra " * 9000] * (blank > 0) + [""] * blank
    n = len(blobs)
    boosts, days, ids = rng.integers(0, 3, n) * (rng.random(n) < .5), rng.integers(0, 4, n), rng.permutation(n).astype(np.int64)
    queries = [Counter(str(w) for w in rng.choice([*words, "nichts"], rng.integers(1, 6))) for _ in range(120)] + [Counter(), Counter({"nichts": 2})]
    rows, whole = [], np.bincount
    monkeypatch.setattr(R, "_LANES", 64)
    monkeypatch.setattr(R, "_SCORES", 12000)
    monkeypatch.setattr(R.np, "bincount", lambda *a, **b: rows.append(1) or whole(*a, **b))
    got = {}
    for q, a, s in zip(*R.best_of_tile(blobs, boosts, days, ids, queries, k)):
        got.setdefault(int(q), []).append((int(ids[a]), int(s)))
    for q, tokens in enumerate(queries):
        score = [int(boosts[i]) + sum(m * (30 + 3 * b.count(t)) for t, m in tokens.items() if t in b) for i, b in enumerate(blobs)]
        best = sorted((i for i in range(n) if score[i]), key=lambda i: (-score[i], days[i], -ids[i]))[:k]
        assert sorted(got.get(q, [])) == sorted((int(ids[i]), score[i]) for i in best), tokens
    assert len(rows) <= 8  # the acts of a frequent token are counted once for all queries


def test_acts_to_rank_are_read_once(spark):
    acts = spark.range(30).select(F.col("id").alias("act_id"), F.lit("1999").alias("pub_date"), F.lit(0).alias("boost"), F.concat(F.lit("ato "), F.col("id").cast("string")).alias("blob"))
    plan = R.rank_many(acts, acts.select(F.col("act_id").alias("query_id"), F.col("blob").alias("query")), 2)
    assert "Range (" not in plan._jdf.queryExecution().optimizedPlan().toString() and plan.count() == 60


def test_acts_are_not_repeated_for_some_hundred_queries(spark):
    acts = spark.range(300).select(F.col("id").alias("act_id"), F.lit("1999").alias("pub_date"), F.lit(0).alias("boost"), F.concat(F.lit("ato "), F.col("id").cast("string")).alias("blob"))
    asked = spark.range(1500).select(F.col("id").alias("query_id"), F.concat(F.lit("ato "), F.col("id").cast("string")).alias("query"))
    plan = R.rank_many(acts, asked, 2)
    assert "sequence(0, 0" in plan._jdf.queryExecution().analyzed().toString() and plan.count() == 3000


def test_mirror_records_are_made_after_the_exchange(spark):
    rows = spark.createDataFrame([(1, 20000101, 1, "01_a", "2000", "01", "01", "texto")], "act_id long, edition_id long, seq int, base string, year string, month string, day string, excerpt string")
    out = S.mirror_records(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.index("json") < plan.index("rebalance")
    assert '"trecho":"texto"' in out.first()["record"]


def test_first_act_title_ends_the_reading(spark, cfg):
    df = spark.createDataFrame([("Nada aqui\nPORTARIA Nº 5/2001\nDECRETO Nº 9/2002",), ("sem título",), ("EDITAL\nNº 3/1999",), (None,)], "t string")
    x = X.extract_type_number("t", cfg)
    got = [tuple(r) if (r := v["x"]) else None for v in df.select(x.alias("x")).collect()]
    assert got == [("Portaria", "5/2001"), None, ("Edital", None), None]
    assert "aggregate(" in str(x)  # lines behind the first title are not matched


def test_cut_organ_rules_have_a_second_piece(spark, cfg):
    rules = [r for r in _triggered_rules(cfg) if r[0] == cfg.truncated_stem.lower() and "DE" in r[1]]
    assert len(rules) == 3 and all(r[3] for r in rules)
    df = spark.createDataFrame([("PREFEITURA MUNICIPAL DE AU\nCÂMARA MUNICIPAL DE AU, MUNICIPIO DE AU",)], "t string")
    assert df.select(normalize_scan("t", cfg)).first()[0].count("rora") == 3


def test_plain_text_is_folded_without_a_translation(spark):
    df = spark.createDataFrame([("ABC d",), ("ÁÇÃO Nº 1",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(fold("t")).collect()] == ["abc d", "acao no 1", None, ""]
    assert "octet_length" in str(fold(F.col("t")))


def test_advertisement_is_judged_on_the_folded_text(spark, cfg):
    words = "Farmácia Loterias " + "x " * 20 + "AURORA"
    df = spark.createDataFrame([(1, 1, 0, 1, words), (1, 2, 0, 1, "Cidade de Aurora CEP 87670-000"), (1, 3, 0, 1, "Marca: Aurora")], "edition_id long, page int, seg_no int, block int, text string")
    assert sorted((r["page"], r["label"]) for r in D.find_mentions(df, cfg).collect()) == [(2, "Aurora"), (2, "CEP 87670-000")]


def test_blanks_that_stand_alone_are_not_replaced(spark):
    texts = ["a b", "  a \t b\n\n c ", "\t", "a\u000b b", "a  b \n", " a", "", None, "x  y", "a\r\n b"]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(squeeze("t"), X.squeezed_lines(F.col("t"))).collect()]
    plain = lambda t, p: re.sub(p, " ", t, flags=re.A)
    assert got == [(None, None) if t is None else (plain(t, r"\s+").strip(" "), [s for x in plain(t, r"[^\S\n]+").split("\n") if (s := x.strip(" "))]) for t in texts]
    assert "*| " in str(squeeze("t"))


def test_tax_digits_may_stand_apart(spark, cfg):
    texts = ["11.222.333/0001-81", "1 1a2\n2-2.3", "11.222.4 44555 666", "112 2 2", "4x4555x6", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(has_entity_taxid("t", cfg)).collect()]
    assert got == [any(c[:6] in re.sub(r"\D", "", t or "") for c in cfg.tax_roots) for t in texts] and any(got) and not all(got)
    assert "regexp_replace" not in str(has_entity_taxid("t", cfg))


def test_terms_are_looked_for_without_excerpts(spark, cfg):
    texts = ["Aurora", "a Aurora b", "xAurora", "Marca: Aurora", "CEP 87.670-000", "CEP 87.111-000", "87670", "Prefeitura de Aurora", "Farmácia Loterias " + "x " * 20 + "AURORA", "nada", "", "CNPJ 11.222.333/0001-81"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(D.has_mention(F.col("t"), fold("t"), cfg).alias("h"), (F.size(D.mention_array(F.col("t"), cfg)) > 0).alias("m")).collect()
    assert [r["h"] for r in got] == [r["m"] for r in got] and {r["h"] for r in got} == {True, False}
    assert "..." not in str(D.has_mention(F.col("t"), fold("t"), cfg))
