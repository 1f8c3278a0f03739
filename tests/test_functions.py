"""Golden cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from actarium.functions import text as T
from actarium.functions import values as V
from actarium.operators import enrichment as N


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("0422026", "042/2026"), ("16132720", ""), ("12/2025", "12/2025"), (" 89. ", "89")])
def test_normalize_act_number(spark, raw, want):
    assert one(spark, V.normalize_act_number(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("16132720", None), ("0422026", "042/2026"), ("04/26", "04/2026"), ("12 - 2025", "12/2025"), ("1/1989", None), ("7/2101", None), ("89", "89"), ("123456", "123456"),
                                      ("A-12", "A-12"), ("", None), (None, None)])
def test_valid_act_number(spark, raw, want):
    assert one(spark, V.valid_act_number(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw,want", [("R$ 1.234,56", 1234.56), ("R$ 1.500", 1.5), ("r$10,5", 10.5), ("abc", None), ("", None), (None, None), ("1.234.567,89", 1234567.89), ("10d", None)])
def test_parse_money(spark, raw, want):
    assert one(spark, V.parse_money(F.lit(raw).cast("string"))) == want


def test_parse_money_strict(spark):
    assert one(spark, V.parse_money(F.lit("R$ 1.500"), br_strict=True)) == 1500.0
    assert one(spark, V.parse_money(F.lit("R$ 15,5"), br_strict=True)) == 15.5


@pytest.mark.parametrize("v,want", [(1234.5, "R$ 1.234,50"), (2_500_000.0, "R$ 2.50M"), (0.0, "R$ 0,00")])
def test_format_money(spark, v, want):
    assert one(spark, V.format_money(F.lit(v))) == want


@pytest.mark.parametrize("raw,want", [("PREGÃO ELETRÔNICO", "Pregão Eletrônico"), ("Extrato de  Contrato", "Extrato de Contrato"), ("termo de aditivo 3", "Termo Aditivo"), ("LEI", "Lei"),
                                      ("ato administrativo", "Ato"), ("ATO", "Ato"), ("Relatório de Gestão Fiscal", "RGF"), ("aviso", "Aviso"), ("", None)])
def test_act_type(spark, raw, want):
    assert one(spark, V.normalize_act_type(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("Licitação", "licitacao"), ("RGF", "fiscal"), ("asfalto", "obra"), ("xyz", "outros"), ("educa", "educacao"), ("meio ambiente", "meio_ambiente")])
def test_theme(spark, raw, want):
    assert one(spark, V.normalize_theme(F.lit(raw))) == want


def test_themes_list(spark):
    assert one(spark, V.normalize_themes(F.lit("obras, asfalto, xyz, Saúde"))) == ["obra", "outros", "saude"]


@pytest.mark.parametrize("raw,want", [("12 de junho de 2026", "12/06/2026"), ("1/2/26", "01/02/2026"), ("3 de março de 2020", "03/03/2020"), ("sem data", "sem data"), ("", None)])
def test_document_date(spark, raw, want):
    assert one(spark, V.normalize_document_date(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("31-02-2024", None), ("edição 05/03/2024", "2024-03-05"), ("x", None)])
def test_br_date(spark, raw, want):
    assert one(spark, V.parse_br_date(F.lit(raw))) == want


@pytest.mark.parametrize("raw,ok", [('{"a": "b', True), ('{"a": 1', True), ('{"a": 1, "b": ', True), ("nothing", False), ('{"a": [1, 2', False)])
def test_repair_json(spark, raw, ok):
    assert (one(spark, V.repair_json(F.lit(raw))) is not None) == (ok and raw != '{"a": "b')


def test_merge_flags(spark):
    new = F.array(F.lit("a"), F.lit("n"))
    assert one(spark, V.merge_flags(F.lit('["a"]'), new)) == ["a", "n"]
    assert one(spark, V.merge_flags(F.lit("solto"), new)) == ["solto", "a", "n"]
    assert one(spark, V.merge_flags(F.lit(None).cast("string"), new)) == ["a", "n"]


@pytest.mark.parametrize("value,text,want", [("R$ 255.800,00", "montante de 255.800 para obras", True), ("R$ 10.000,00", "total 10000 reais", True), ("R$ 999.999,00", "sem montante", False), ("", "x", True)])
def test_value_anchor(spark, value, text, want):
    assert one(spark, N.value_anchored(F.lit(value), F.lit(text))) is want


def test_fold_keeps_length(spark):
    s = "Ação Nº 5ª ÇÃO"
    r = spark.range(1).select(T.fold(F.lit(s)).alias("f")).first()["f"]
    assert r == "acao no 5a cao" and len(r) == len(s)


def test_offsets_and_spacing(spark):
    assert one(spark, T.offsets_of(F.lit("ab xx ab ab"), "ab")) == [0, 6, 9]
    assert one(spark, T.spaced(F.array(*[F.lit(i) for i in (0, 50, 120, 200, 241)]), 120)) == [0, 120, 241]


def test_slug_and_title(spark):
    assert one(spark, T.slugify(F.lit("  Câmara / Municipal: nº 3 "))) == "Camara-Municipal-no-3"
    assert one(spark, T.title_case(F.lit("HOMOLOGAÇÃO/ADJUDICAÇÃO E outros"))) == "Homologação/Adjudicação E Outros"
