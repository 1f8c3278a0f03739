"""Golden cases of layout, extraction and the detection run."""

import pytest
from pyspark.sql import functions as F

from actarium.operators import detection as D
from actarium.operators import extraction as X
from actarium.operators import layout as L


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


WORDS = "page bigint, col int, x_offset int, pos bigint, text string, conf string, block_num int, par_num int, line_num int, lft int, top int, width int, height int"


def test_words_to_blocks(spark):
    rows = [(1, 0, 500, 1, "DECRETO", "90", 1, 1, 1, 10, 5, 20, 10), (1, 0, 500, 2, "N", "80", 1, 1, 1, 40, 5, 5, 10), (1, 0, 500, 3, "001", "70", 1, 1, 1, 50, 5, 9, 12), (1, 0, 500, 4, "ruim", "-1", 1, 1, 1, 0, 0, 1, 1),
            (1, 0, 500, 5, "fim", "50", 1, 1, 2, 10, 30, 20, 10)]
    b = L.words_to_blocks(spark.createDataFrame(rows, WORDS)).collect()
    assert len(b) == 1 and b[0]["text"] == "DECRETO N 001\nfim" and b[0]["l"] == 510 and b[0]["block"] == 1001 and (b[0]["t"], b[0]["b"]) == (5, 40)


def test_group_blocks_gap(spark, cfg):
    rows = [(1, 1001, 1, "DECRETO Nº 1/2020", 0, 0, 10, 20), (1, 1002, 2, "corpo", 0, 100, 10, 120), (1, 1003, 3, "longe", 0, 900, 10, 950), (1, 1004, 4, "perto do longe", 0, 960, 10, 970)]
    g = L.group_blocks(spark.createDataFrame(rows, "page bigint, block int, seq bigint, text string, l int, t int, r int, b int"), cfg).orderBy("t").collect()
    assert [r["text"] for r in g] == ["DECRETO Nº 1/2020\ncorpo", "longe", "perto do longe"]


@pytest.mark.parametrize("text,want", [
    ("PREFEITURA MUNICIPAL DE AURORA\nDecreto", "Prefeitura Municipal de Aurora"), ("Câmara Municipal de Aurora", "Câmara Municipal de Aurora"), ("MUNICÍPIO DE AURORA", "Município de Aurora"),
    ("PREFEITURA MUNICIPAL DE AU\nLEI", "Prefeitura Municipal de Aurora"), ("Art. 5 da Prefeitura de Aurora", None), ("Prefeitura Municipal de Florai e texto", None),
    ("Conselho Municipal de Saúde\nreunido em Aurora", "Conselho Municipal de Saúde de Aurora"), ("CNPJ 11 222 333/0001-81", "Prefeitura Municipal de Aurora")])
def test_organ(spark, cfg, text, want):
    assert one(spark, X.extract_organ(F.lit(text), cfg)) == want


@pytest.mark.parametrize("text,want", [
    ("DECRETO Nº 012/2026\nDispõe", ("Decreto", "012/2026")), ("QUINTO TERMO ADITIVO DE CONTRATO Nº 3/2020", ("Termo Aditivo", "3/2020")), ("LEIN° 5/2021", ("Lei", "5/2021")),
    ("nos termos da lei federal 8666", None), ("PORTARIA 89\nJoão CPF 111.222.333-44", ("Portaria", "89")), ("RATO DO CONTRATO Nº 04/2026", ("Extrato de Contrato", "04/2026"))])
def test_type_number(spark, cfg, text, want):
    r = one(spark, X.extract_type_number(F.lit(text), cfg))
    assert (tuple(r) if r else None) == want


def test_preferred_number(spark, cfg):
    assert one(spark, X.preferred_number(F.lit("EXTRATO DO CONTRATO Nº 04/2026 e contrato nº 9/2027"), F.lit("Extrato de Contrato"), cfg)) == "04/2026"
    assert one(spark, X.preferred_number(F.lit("Nº 070/2023 e Nº 02/2025"), F.lit(""), cfg)) == "02/2025"


@pytest.mark.parametrize("number,text,want", [("089/2036", "Portaria Nº 089/2036 publicada", True), ("089/2036", "089/2036 solto", False), ("89", "número: 89", True), ("4/2020", "n. 4 - 2020", True)])
def test_anchored(spark, number, text, want):
    assert one(spark, X.number_anchored(F.lit(number), F.lit(text))) is want


def test_value_and_date(spark, cfg):
    assert one(spark, X.extract_value(F.lit("R$ 10,00 e valor de R$ 5,00; R$ 99,00"))) == "R$ 5,00"
    assert one(spark, X.extract_value(F.lit("R$ 10,00 e R S 1.099,00."))) == "R$ 1.099,00"
    assert one(spark, X.extract_date(F.lit("em 01/02/2020, aos 12 de junho  de 2026"), cfg)) == "12 de junho de 2026"


@pytest.mark.parametrize("text,want", [("Prefeitura Municipal de Florai publica", True), ("Prefeitura Municipal de Aurora publica", False), ("texto sobre o município de Colorado", True),
                                       ("PREFEITURA MUNICIPAL DE AURORA CNPJ 11.222.333/0001-81 " + "x " * 60 + "convênio com a Prefeitura de Florai", False)])
def test_foreign(spark, cfg, text, want):
    assert one(spark, X.foreign_entity(F.lit(text), cfg)) is want


def test_detect_end_to_end(spark, cfg):
    act = "PREFEITURA MUNICIPAL DE AURORA\nDECRETO Nº 10/2026\nSÚMULA: Abre crédito\nvalor de R$ 1.000,00\nAurora, 12 de junho de 2026"
    pages = spark.createDataFrame([(1, 1, act, "texto"), (1, 2, act.replace("10/2026", "11/2026"), "texto"), (1, 3, "Prefeitura Municipal de Florai\nDECRETO Nº 5/2026\ntexto em Aurora", "texto"),
                                   (2, 1, "nada aqui", "ocr")], "edition_id bigint, page int, text string, method string")
    d = D.detect(pages, cfg)
    acts = {r["number"]: r for r in d.acts.collect()}
    assert set(acts) == {"10/2026", "11/2026"}
    a = acts["10/2026"]
    assert (a["organ"], a["act_type"], a["doc_date"], a["value"]) == ("Prefeitura Municipal de Aurora", "Decreto", "12 de junho de 2026", "R$ 1.000,00") and "Abre crédito" in a["subject"]
    m = {r["edition_id"]: r for r in d.metrics().collect()}
    assert m[1]["final_acts"] == 2 and m[1]["neighbour_drops"] >= 1 and m[2]["weak_pages"] == 1 and m[1]["pages"] == 3
    roll = {r["edition_id"]: r for r in d.rollup().collect()}
    assert roll[1]["found"] and not roll[2]["found"] and roll[1]["pages"][:2] == [1, 2]


def test_fallback_segment(spark, cfg):
    page = "jornal do dia " * 5 + "\nPREFEITURA MUNICIPAL DE AURORA\n" + "DECRETO Nº 10/2026 " * 5
    w = one(spark, L.fallback_windows(F.lit(page), cfg))
    assert any("PREFEITURA MUNICIPAL DE AURORA" in s["text"].upper() for s in w)


def test_split_multi_act(spark, cfg):
    body = "texto do ato oficial publicado hoje. " * 15
    page = "\n".join(f"PREFEITURA MUNICIPAL DE AURORA\nDECRETO Nº {i}/2026\n{body}" for i in (1, 2, 3))
    s = one(spark, L.split_multi_act(F.lit(page), F.lit(1), cfg))
    assert len(s) == 3 and [x["block"] for x in s] == [101, 102, 103] and "Nº 2/2026" in s[1]["text"]
