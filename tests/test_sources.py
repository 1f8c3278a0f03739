"""Streamed files: JSON documents and paged text, read back equal."""

import json
import uuid

from actarium.operators.lineage import shared_folder
from actarium.sources import ocr as O


def test_documents_are_streamed_and_read_back(spark):
    rows = [(e, p, f'Página "{p}"\n\tlinha \\ dois \U0001f44d', "ocr") for e in range(3) for p in range(1, 40)] + [(7, 1, None, None), (7, 1, "again", "ocr")]
    pages = spark.createDataFrame(rows, "edition_id bigint, page int, text string, method string").repartition(6)
    path = f"{shared_folder(spark)}/docs-{uuid.uuid4().hex}"
    assert 0 < O.write_ocr_json(pages, path) <= 4
    docs = O.read_ocr_json(spark, path, lines=True)
    got = {(r["edition_id"], r["page"], r["text"], r["method"]) for r in O.document_pages(docs).collect()}
    assert got == {(e, p, t or "", m or "ocr") for e, p, t, m in rows}
    whole = {r["edition_id"]: r["texto_completo"] for r in docs.collect()}
    assert whole[1] == "\n\n".join(f"--- Página {p} (ocr) ---\n{t}" for e, p, t, _ in sorted(rows[:117]) if e == 1)
    for f in docs.select("source").distinct().collect():
        with open(f["source"].removeprefix("file://")) as lines:
            assert all(json.loads(line)["cache_version"] == 2 for line in lines)
    most = O.document_pieces(pages).selectExpr("max(length(piece))").first()[0]
    assert most < 200  # no piece is larger than a page


def test_paged_text_round_trip(spark):
    rows = [(e, p, f"texto {p}\n\nfim", "ocr-hq") for e in range(3) for p in range(1, 30)]
    path = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"
    assert O.write_paged_text(spark.createDataFrame(rows, "edition_id bigint, page int, text string, method string"), path) == 3
    got = {(int(r["edition_id"]), r["page"], r["text"], r["method"]) for r in O.read_paged_text(spark, path).collect()}
    assert got == set(rows)
    assert O.write_paged_text(spark.createDataFrame(rows[:1], "edition_id bigint, page int, text string, method string"), path) == 1  # the folder is emptied first
    assert O.read_documents(spark, path).count() == 1
