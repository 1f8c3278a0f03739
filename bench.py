"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Every query is planned and run to the end with all its rows (noop sink). The session is warmed by one cheap query first.
"""

from __future__ import annotations

import json
import os
import sys
import time

from actarium.plans import catalog
from actarium.plans.registry import QUERIES, Tables
from actarium.session import local_session

HEADLINE = ("D18_detect", "D5_dedup_mentions", "E5_dedup_acts", "E6_fuse_fragments", "F3_merge_enrichment", "F12_anomalies", "G4_confidence", "G9_diagnose_gaps",
            "H5_rank_acts", "I5_ranking", "I9_sum_values", "I11_edition_board", "C1_words_to_blocks", "B23_tokens", "K8_run_stats")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    catalog.load()
    spark = local_session(app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, sf_dir)
    t.orders.groupBy("o_orderstatus").count().collect()
    times: dict[str, float] = {}
    for n in names:
        t0 = time.time()
        QUERIES[n](t).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
