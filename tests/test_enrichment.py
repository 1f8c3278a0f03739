"""Anchored numbers against the plain pattern, citations, packs and whole lists."""

import random
import re

from pyspark.sql import functions as F

from actarium.config import fold_py
from actarium.operators import enrichment as N
from actarium.operators import extraction as X


def test_anchored_numbers_equal_the_pattern(spark):
    rng = random.Random(9)
    piece = lambda: rng.choice(("n", "nº ", "no ", "n. ", "n.", "numero: ", "numero ", "12", "095", "2026", "/", " / ", "-", ".", " ", "a", "n 12", "\n", "º"))
    numbers = ["12", "095/2026", "12/095", "095", "2026", "12.095", "12-a", "1/2/3", "12/2026", "", None]
    rows = [(i, rng.choice(numbers), "".join(piece() for _ in range(rng.randrange(25))) if i % 40 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "i int, n string, x string")
    got = {r["i"]: r for r in df.select("i", X.number_anchored("n", "x").alias("a"), F.lower(F.coalesce(X.valid_act_number("n"), F.trim(X.text("n")))).alias("v")).collect()}
    for i, _, x in rows:
        v = got[i]["v"]
        quoted = re.sub("/", r"\\s*[/\\-.]\\s*", re.sub(r"([^a-z0-9/])", r"\\\1", v))
        assert got[i]["a"] == bool(v and x and re.search(r"(?:n[o°.]?\s*|numero\s*[:\s]*)" + quoted + r"\b", fold_py(x))), (v, x)
    assert sum(r["a"] for r in got.values()) > 50


ACT = "act_id bigint, edition_id bigint, act_type string, number string, organ string, value string, pub_date string, doc_date string, subject string, summary string"


def test_citations_and_similar_pack(spark):
    acts = spark.createDataFrame([(i, 10 * i, "Lei", f"{i}/2020", None, "" if i % 2 else "R$ 1", None, None, f"assunto {i}", "") for i in range(1, 9)], ACT)
    similar = spark.createDataFrame([(1, r, a) for r, a in enumerate((5, 2, 7), 1)] + [(2, 1, 8)], "query_id bigint, rank int, act_id bigint")
    items = N.similar_items(acts, similar)
    answers = spark.createDataFrame([(1, ["2", "x", "9", "0", "1", None, "2"]), (2, []), (3, ["1"])], "act_id bigint, cited array<string>")
    got = sorted((r["act_id"], r["place"], r["cited_id"], r["edition_id"], r["number"]) for r in N.citations(answers, items).collect())
    assert got == [(1, 0, 2, 20, "2/2020"), (1, 4, 5, 50, "5/2020"), (1, 6, 2, 20, "2/2020")]
    packs = {r["act_id"]: r for r in N.similar_context(items).collect()}
    assert packs[1]["n_items"] == 3 and packs[1]["context"].startswith("[1] id=5 Lei 5/2020  valor=— data=?\nassunto 5\n[2] id=2 Lei 2/2020  valor=R$ 1")


def test_pending_acts_are_all_listed(spark):
    acts = spark.createDataFrame([(i, i % 7, i % 2, "s" if i % 3 else None) for i in range(500)], "act_id bigint, edition_id bigint, enriched int, summary string")
    want = [i for e in range(7) for i in range(500) if i % 7 == e and (i % 2 == 0 or i % 3 == 0)]
    assert [r["act_id"] for r in N.pending_enrichment(acts).collect()] == want
    assert N.pending_enrichment(acts, 10).count() == 10


def test_typed_numbers_are_searched_for_where_their_word_stands(spark, cfg):
    """A pattern never matches without its word, and the guarded search finds what the patterns find in every text."""
    import random
    import re

    from actarium import fixed

    rnd = random.Random(2)
    pieces = ["extrato do ", "contrato ", "administrativo ", "termo aditivo ", "decreto municipal ", "portaria ", "dispensa ", "pregao eletronico ", "termo de ", "homologacao ", "e adjudicacao ",
              "n. ", "no ", "12/2024 ", "7 - 25 ", "3/1999 ", "88 ", "\n", "x "]
    texts = ["".join(rnd.choices(pieces, k=rnd.randrange(8))) for _ in range(400)]
    assert not [1 for t in texts for p, w in zip(fixed.TYPED_NUMBERS, fixed.TYPED_TRIGGERS, strict=True) if re.search(p, t) and w not in t]

    def latest(t):
        clean = [n.replace(" ", "") for p in (*fixed.TYPED_NUMBERS, fixed.GENERIC_NUMBER) for n in re.findall(p, t)]
        parts = [re.split("[/-]", re.sub(r"\s", "", n)) for n in clean]
        years = [(int(y if len(y) == 4 else f"20{y}"), n) for n, y in parts]
        return max((y for y, _ in years), default=None)

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in rows.select("i", N.resolve_number(F.lit(""), F.lit(None).cast("string"), "t", "t", F.lit(None).cast("string"), cfg).alias("n")).collect()}
    assert {i: n and int(n.split("/")[1]) for i, n in got.items()} == {i: latest(t) for i, t in enumerate(texts)}


def test_similar_contexts_of_every_act(spark, tmp_path):
    import __spark_entry__ as entry
    tables = {
        "nation": spark.createDataFrame([(0, "NATION_0")], "n_nationkey bigint, n_name string"),
        "customer": spark.createDataFrame([(1, "C1", "BUILDING", 0)], "c_custkey bigint, c_name string, c_mktsegment string, c_nationkey bigint"),
        "orders": spark.createDataFrame([(k, 1, "1996-01-0%d" % (1 + k % 5), "1-URGENT", "O", 100.0 * k) for k in range(95, 106)],
                                        "o_orderkey bigint, o_custkey bigint, o_orderdate string, o_orderpriority string, o_orderstatus string, o_totalprice double"),
        "lineitem": spark.createDataFrame([("1996-01-01",)], "l_shipdate string")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["act_id"]: r["n_items"] for r in entry.queries()["F14_context_similar"](spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys(range(95, 106), 6)
