"""Ranked search, timelines and candidacy against the plain rules."""

import random
import re

import pytest

from actarium.operators import ranking as R
from actarium.operators import search as H

ACT = "act_id bigint, pub_date string, act_type string, number string, organ string, subject string, summary string, excerpt string, value string, themes string, edition_title string, edition_id bigint"
WORDS = ("obra", "asfalto", "de", "saude", "decreto", "pre", "prefeitura", "municipal", "a1", "22", "x" * 40)


@pytest.fixture(scope="module")
def acts(spark):
    rng = random.Random(1)
    pick = lambda *xs: rng.choice(xs)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))
    rows = [(i, pick(None, "2020-01-0%d" % rng.randrange(1, 9)), pick("Lei", "Decreto", None), pick("1/2020", "2/2020", "", None), pick("Prefeitura Municipal", "Câmara Prefeitura", "", None), text(4), pick(None, "", text(5)),
             text(30), pick(None, "", "R$ 1,00"), pick(None, "obra"), "edição", i % 5) for i in range(400)]
    rows += [(400, None, None, None, None, "obra " * 5000, None, "", None, None, None, 1), (401, None, None, None, None, None, None, None, None, None, None, 1)]
    return rows, spark.createDataFrame(rows, ACT).repartition(5)


def folded(s):
    return s.lower().translate(str.maketrans("áàâãéêíóôõúç", "aaaaeeiooouc"))


def ranked(rows, query, k, skip=None):
    toks = re.findall("[a-z0-9]{2,}", folded(query or ""))
    if not toks:
        newest = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]), reverse=True)
        return [(r[0], None) for r in newest if r[0] != skip][:k]
    out = []
    for r in rows:
        blob = folded(" ".join(r[i] or "" for i in (2, 3, 4, 5, 6, 7, 8, 10)))
        s = sum(30 + 3 * blob.count(t) for t in toks if t in blob) + (5 if r[6] else 0) + (2 if r[8] else 0)
        if s > 0 and r[0] != skip:
            out.append((-s, r[1] or "", -r[0]))
    return [(-i, round(-s / 10, 2)) for s, _, i in sorted(out)[:k]]


@pytest.mark.parametrize("rows_per_block, queries_per_block", [(8192, 512), (37, 2)])
def test_rank_acts_many(spark, acts, monkeypatch, rows_per_block, queries_per_block):
    rows, df = acts
    monkeypatch.setattr(R, "BLOCK_ROWS", rows_per_block)
    monkeypatch.setattr(R, "QUERY_BLOCK", queries_per_block)
    monkeypatch.setattr(R, "_FAN", 3)
    queries = ["obra asfalto", "Saúde de de PREFEITURA", "zz", "e", "", None, "pre pre ob 22", "x" * 41]
    got = {}
    for r in H.rank_acts_many(df, spark.createDataFrame(list(enumerate(queries)), "query_id bigint, query string"), 7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["act_id"], r["score"]))
    for i, q in enumerate(queries):
        want = ranked(rows, q, 7)
        assert [x[1:] for x in sorted(got.get(i, []))] == want, q


def test_similar_acts_of_every_act(acts):
    rows, df = acts
    got = {}
    for r in H.similar_acts(df, df, 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["act_id"], r["score"]))
    for r in rows:
        query = " ".join(x for x in (r[2], r[4], r[5] or r[6], r[9]) if x)
        assert [x[1:] for x in sorted(got.get(r[0], []))] == ranked(rows, query, 4, r[0])


def test_search_without_acts(spark, acts):
    none = acts[1].limit(0)
    assert H.rank_acts_many(none, spark.createDataFrame([(1, "obra"), (2, "")], "query_id bigint, query string")).collect() == []


def test_timeline_of_every_act(spark):
    rng = random.Random(6)
    organs = ["Prefeitura Municipal de A", "Prefeitura", "pre", "a", "Município", "", None, "Câmara Municipal", "xy"]
    types = ["Contrato", "Termo Aditivo", "Decreto", "Extrato de Contrato", "", None]
    rows = [(i, i % 9, rng.choice(("1/20", " 1/20 ", "7", "", None, None)), rng.choice(organs), rng.choice(types)) for i in range(300)]
    days = [(e, None if e == 4 else f"2020-01-{e + 1:02d}") for e in range(8)]
    df, editions = spark.createDataFrame(rows, "act_id bigint, edition_id bigint, number string, organ string, act_type string"), spark.createDataFrame(days, "edition_id bigint, pub_date string")
    low, day = lambda x: (x or "").lower(), dict(days)
    from actarium import fixed
    want = set()
    for t in rows:
        hits = []
        for a in rows:
            if a[0] == t[0] or a[1] not in day:
                continue
            num = low(t[2]).strip()
            if num:
                ok = low(a[2]).strip() == num
            else:
                ok = bool(folded(t[4] or "")) and any(c in folded(a[4] or "") for c in fixed.CHAIN_TYPES) and low(t[3])[:40] in low(a[3])
            if ok:
                hits.append((day[a[1]] is not None, day[a[1]] or "", a[0]))
        want |= {(t[0], a, n) for n, (_, _, a) in enumerate(sorted(hits)[:5], 1)}
    got = {(r["target_id"], r["act_id"], r["rank"]) for r in H.act_timeline(df, editions, df, 5).collect()}
    assert got == want and len(want) > 300


def test_candidacy_reads_whole_editions(spark, cfg):
    pages = [(1, p, "texto sem sinal " * 300, "x") for p in range(20)] + [(1, 20, "y " * 3000 + " decreto da prefeitura municipal de aurora r$ 10,00", "x"), (2, 1, None, "x")]
    editions = spark.createDataFrame([(1, "Edição"), (2, None), (3, "Prefeitura Municipal de Florai")], "edition_id bigint, title string")
    got = {r["edition_id"]: r for r in H.edition_candidacy(editions, spark.createDataFrame(pages, "edition_id bigint, page int, text string, method string"), cfg).collect()}
    assert got[1]["score"] >= 55 and "menciona o alvo" in got[1]["reasons"] and got[2]["score"] == 0 and got[3]["reasons"] == ["vizinho:florai", "órgão oficial"] or got[3]["score"] == 0
