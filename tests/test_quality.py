"""Golden cases of year repair, confidence, anomalies, search, sums and budgets."""

import pytest
from pyspark.sql import functions as F

from actarium.config import QualityConfig
from actarium.operators import enrichment as N
from actarium.operators import quality as G
from actarium.operators import reports as R
from actarium.operators import search as H
from actarium.streaming import jobs as J

ACT = ("act_id bigint, edition_id bigint, pub_date string, page int, category string, organ string, act_type string, number string, doc_date string, subject string, value string, excerpt string, summary string, "
       "feedback string, importance int, notify int, themes string, validation string, flags string, anomaly int, anomaly_reason string, enriched int")


def act(**kw):
    d = dict(act_id=1, edition_id=1, pub_date="2026-07-01", page=1, category="publicacao_oficial", organ="Prefeitura Municipal de Aurora", act_type="Decreto", number="095/2026", doc_date="01/07/2026", subject="s", value=None,
             excerpt="texto " * 30, summary="resumo", feedback=None, importance=None, notify=None, themes=None, validation=None, flags=None, anomaly=0, anomaly_reason=None, enriched=1)
    d.update(kw)
    return tuple(d[c.split()[0]] for c in ACT.split(", "))


@pytest.mark.parametrize("number,excerpt,final,corrected,review", [
    ("095/2036", "sem marca", "095/2026", True, False), ("12/2025", "x", "12/2025", False, False), (None, "x", None, False, False), ("89", "x", "89", False, False),
    ("089/2036", "Portaria Nº 089/2036", "089/2036", False, True), ("5/2099", "x", None, True, True)])
def test_year_repair(spark, number, excerpt, final, corrected, review):
    f = spark.range(1).select(G.correct_number_year(F.lit(number).cast("string"), F.lit("2026-07-01"), F.lit(None), 2026, F.lit(excerpt)).alias("f")).first()["f"]
    assert (f["final"], f["corrected"], f["review"]) == (final, corrected, review)


def confident(spark, cfg, **kw):
    df = spark.createDataFrame([act(**kw)], ACT)
    return G.confidence(G.apply_number_correction(df, 2026), cfg, 2026).first()


def test_confidence_levels(spark, cfg):
    full = confident(spark, cfg)
    assert full["confidence"] >= 85 and full["confidence_level"] == "alta"
    assert confident(spark, cfg, number="095/2036")["confidence_level"] == "alta"
    mid = confident(spark, cfg, act_type="Contrato", number=None, value="R$ 1,00")
    assert 55 <= mid["confidence"] < 85 and mid["confidence_level"] == "media"
    low = confident(spark, cfg, act_type="Outros", organ=None, number=None, summary=None, excerpt="curto", doc_date=None)
    assert low["confidence"] <= 25 and low["confidence_level"] == "revisar"
    assert confident(spark, cfg, number="089/2036", excerpt="Nº 089/2036 " + "x" * 90)["confidence_level"] == "revisar"
    foreign = confident(spark, cfg, organ="Prefeitura de Florai")
    assert foreign["confidence_parts"]["orgao"] == 0
    weak = confident(spark, cfg, act_type="Ato", number=None, summary=None, doc_date=None)
    assert weak["confidence"] < 55
    assert confident(spark, cfg, feedback="errado")["confidence"] <= 50
    assert confident(spark, cfg, act_type="Contrato", number=None, feedback="correto")["confidence"] == mid["confidence"] + 10


def test_anomalies(spark):
    rows = [act(act_id=i, act_type="Contrato", value="R$ 1.000,00") for i in range(1, 7)] + [act(act_id=7, act_type="Contrato", value="R$ 50.000,00"), act(act_id=8, act_type="Dispensa", value="R$ 250.000,00", importance=4, notify=0)]
    got = {r["act_id"]: r for r in N.anomalies(spark.createDataFrame(rows, ACT), chunk=100).collect()}
    assert got[7]["anomaly"] == 1 and "mediana" in got[7]["reason"] and got[8]["anomaly"] == 1 and got[8]["notify"] == 1 and got[3]["anomaly"] == 0


def test_rank_many_equals_one_by_one(spark):
    words = ["obra", "asfalto", "decreto", "saude", "obras", "contratado"]
    rows = [act(act_id=i, subject=" ".join(words[j] for j in range(6) if (i >> j) & 1), summary=("r" if i % 2 else None), value=("R$ 1,00" if i % 3 == 0 else None), excerpt="de obra obra" if i % 5 == 0 else "") for i in range(64)]
    acts = spark.createDataFrame(rows, ACT)
    queries = {1: "obra asfalto", 2: "contrat ado obra obra", 3: "zzz", 4: "as"}
    many = H.rank_acts_many(acts, spark.createDataFrame(list(queries.items()), "query_id int, query string"), 9)
    got: dict = {}
    for r in many.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["act_id"], r["score"]))
    for q, s in queries.items():
        assert got[q] == [(r["act_id"], r["score"]) for r in H.rank_acts(acts, s, 9).collect()], q


def test_sum_values(spark):
    rows = [act(act_id=1, number="030/2026", act_type="Aviso", value="R$ 1.000.000,00"), act(act_id=2, number="030/2026", act_type="Extrato", value="R$ 1.000.000,00"), act(act_id=3, number=None, act_type="Portaria", value="R$ 500,00"),
            act(act_id=4, category="materia_jornalistica", value="R$ 4.000.000,00", number="9/2026")]
    df = spark.createDataFrame(rows, ACT)
    r = R.sum_values(df).first()
    assert (r["total"], r["raw_total"], r["n_unique"]) == (1000500.0, 2000500.0, 2)
    assert R.sum_values(df, exclude_news=False).first()["total"] == 5000500.0


def test_budget(spark):
    ts = F.lit("2026-01-01 10:30:00").cast("timestamp")
    calls = lambda n: spark.range(n).select(ts.alias("ts"))
    q = QualityConfig(per_cycle=5, per_hour=15, per_day=40)
    assert [J.budget_left(calls(n), ts, q).first()["admit"] for n in (0, 14, 20)] == [5, 1, 0]


def test_gap_rules(spark):
    rows = [(1, 12, 0, 1, 0, 10, True), (2, 1, 4, 0, 0, 10, True), (3, 2, 0, 0, 0, 10, False), (4, 12, 0, 1, 5, 10, True), (5, 1, 0, 5, 0, 10, True)]
    df = spark.createDataFrame(rows, "edition_id int, hits bigint, headers bigint, n_acts bigint, weak_pages bigint, pages bigint, cached boolean")
    got = {r["edition_id"]: (r["severity"], r["action"]) for r in G.gap_columns(df).collect()}
    assert got == {1: ("under", "redetect_cache"), 2: ("low", "redetect_cache"), 3: ("under", "force_ocr"), 4: ("critical", "force_ocr"), 5: ("none", "none")}


def test_candidacy(spark, cfg):
    c = lambda t: spark.range(1).select(H.candidacy(F.lit(t), F.lit(""), cfg).alias("c")).first()["c"]
    assert c("Prefeitura Municipal de Aurora - decreto R$ 10,00")["priority"] == 0
    assert c("Prefeitura Municipal de Florai")["score"] == 0 and c("caderno de esporte")["priority"] == 2
