"""Registered queries: contract, and a sample against the checking SQL on the smallest tables."""

import re
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check import TABLES, rows  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = ("A4_extract_links", "B22_normalize_themes", "C5_page_segments", "D6_upsert_mentions", "E9_duplicate_groups", "F6_validate_fields", "G9_diagnose_gaps", "H9_act_timeline", "I12_job_board", "J4_absence_alert",
          "K1_stream_editions", "K9_job_windows_stream")


def test_every_query_has_a_check():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 180
    assert {n for n in set(q) - set(o) if n != "pipeline" and not re.match(r"op\d+_", n)} == set()


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = rows(entry.queries()[name](spark, SF).toPandas())
    assert got == rows(con.sql(entry.oracle_sql()[name]).df())
