"""Alert pauses, sessions of life, upserts and detection over several batches, against brute force."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from actarium.config import QualityConfig
from actarium.operators import detection as D
from actarium.operators.lineage import shared_folder
from actarium.streaming import cooldown as C
from actarium.streaming import jobs as J
from actarium.streaming import streams as S

DAY = dt.datetime(2024, 1, 1)


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


def scratch(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def passed(times, gap):
    last, out = None, []
    for t in sorted(times):
        if last is None or t - last >= gap:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("gap", [1, 5, 20])
def test_steps_of_a_chunk_tell_every_walk(gap):
    rng = random.Random(gap)
    for _ in range(400):
        width = gap * rng.choice((2, 4, 16))
        times = sorted(rng.randrange(width) for _ in range(rng.randrange(1, 60)))
        steps = C.chunk_steps(times, 0, gap)
        for a in (C.NEVER, *range(gap)):
            rest = passed([t for t in times if t >= a], gap)
            assert next((last for entry, last in steps if entry >= a), None) == (rest[-1] if rest else None)


@pytest.mark.parametrize("chunk", [1, 3, 16])
def test_cooldown_of_a_hot_key(spark, chunk):
    """One key holds most rows without an idle hour, others have idle stretches; repeated times, a null key, an event without a time."""
    rng = random.Random(chunk)
    rows = [("hot", rng.randrange(300_000)) for _ in range(3000)] + [(rng.choice(("a", "b", "-", None)), rng.randrange(3_000_000)) for _ in range(500)]
    rows += rows[:50]
    df = spark.createDataFrame([(k, at(t)) for k, t in rows] + [("a", None)], "key string, ts timestamp").repartition(7)
    got = C.cooldown_alerts(df, 60, chunk=chunk).collect()
    assert len(got) == len(rows) + 1 and not [r for r in got if r["ts"] is None and r["emitted"]]
    for key in ("hot", "a", "b", "-", None):
        want = [at(t) for t in passed([t for k, t in rows if k == key], 3600)]
        assert sorted(r["ts"] for r in got if r["key"] == key and r["emitted"]) == want


def test_cooldown_stream_over_batches_that_overlap(spark):
    """Events reach the stream up to the watermark's delay late; what it has passed is final and equals the batch twin."""
    rng = random.Random(4)
    rows = sorted((rng.randrange(100_000), rng.choice(("hot", "hot", "k1", "k2"))) for _ in range(800))
    late = [(t, k, t + rng.randrange(500)) for t, k in rows]  # arrival up to 500 s after the event, the delay allowed is 600 s
    src, ckpt, out = (scratch(spark, n) for n in ("events", "ckpt", "alerts"))
    for part in range(5):
        here = [(k, at(t)) for t, k, seen in late if part * 20_100 <= seen < (part + 1) * 20_100]
        spark.createDataFrame(here, "key string, ts timestamp").coalesce(1).write.mode("append").parquet(src)
    S.to_parquet(C.cooldown_stream(S.read_stream(spark, src, "key string, ts timestamp"), 60, "10 minutes"), out, ckpt)
    got = {(r["key"], r["ts"]) for r in spark.read.parquet(out).collect()}
    final = at(max(t for t, _ in rows) - 600)
    assert got == {(k, at(t)) for k in ("hot", "k1", "k2") for t in passed([t for t, x in rows if x == k], 3600) if at(t) <= final}


def test_alive_sessions(spark):
    q = QualityConfig(heartbeat_seconds=100, cycle_seconds=300)
    rows = [("p", "heartbeat", 0), ("p", "heartbeat", 90), ("p", "cycle", 300), ("p", "heartbeat", 350), ("p", "heartbeat", 601), ("q", "cycle", 10), ("q", "other", 200)]
    df = spark.createDataFrame([(p, k, at(s)) for p, k, s in rows], "process string, kind string, ts timestamp")
    got = {(r["process"], r["start"], r["end"], r["beats"]) for r in J.alive_sessions(df, q).collect()}
    assert got == {("p", at(0), at(190), 2), ("p", at(300), at(600), 2), ("p", at(601), at(701), 1), ("q", at(10), at(310), 1)}


def test_upsert_rewrites_only_what_a_batch_touches(spark):
    src, ckpt, tab = (scratch(spark, n) for n in ("intake", "ckpt", "editions"))
    schema = "url string, title string, pub_date string, seq int"
    spark.createDataFrame([(f"u{i}", f"t{i}", "2024-01-01", 1) for i in range(300)], schema).write.mode("append").parquet(src)
    S.stream_editions(S.read_stream(spark, src, schema, 50), tab, ckpt)
    files = {r["f"]: r["bucket"] for r in S.edition_table(spark, tab).select(F.input_file_name().alias("f"), "bucket").distinct().collect()}
    again = [("u7", "new", None, 2), ("fresh", "", "2024-02-02", 3)]
    for _ in range(2):  # the second time nothing changes
        spark.createDataFrame(again, schema).write.mode("append").parquet(src)
        S.stream_editions(S.read_stream(spark, src, schema, 50), tab, ckpt)
    got = {r["url"]: (r["title"], r["pub_date"]) for r in S.edition_table(spark, tab).collect()}
    assert len(got) == 301 and got["u7"] == ("new", "2024-01-01") and got["fresh"] == ("", "2024-02-02") and got["u8"] == ("t8", "2024-01-01")
    touched = {r["bucket"] for r in S.edition_table(spark, tab).where("url in ('u7', 'fresh')").select("bucket").collect()}
    now = {r["f"] for r in S.edition_table(spark, tab).select(F.input_file_name().alias("f")).distinct().collect()}
    assert {f for f in files if f not in now} == {f for f, b in files.items() if b in touched}


PAGE = "Prefeitura Municipal de Aurora\nDECRETO Nº {n}/2020\nSÚMULA: Dispõe sobre a obra {n}\nO Prefeito de Aurora, no uso de suas atribuições, publica o valor de R$ 1.{n}00,00\n"


def test_detection_of_editions_split_over_batches(spark, cfg):
    pages = [(e, p, PAGE.format(n=10 * e + p % 4), "texto") for e in range(6) for p in range(8)]
    schema = "edition_id bigint, page int, text string, method string"
    src, ckpt, out = (scratch(spark, n) for n in ("pages", "ckpt", "detected"))
    for part in range(4):  # the last delivery touches two editions only
        here = [r for r in pages if (r[1] % 3 == part and (r[0] > 1 or r[1] < 6)) or (part == 3 and r[0] <= 1 and r[1] >= 6)]
        spark.createDataFrame(here, schema).coalesce(1).write.mode("append").parquet(src)
    S.stream_detect(S.read_stream(spark, src, schema), cfg, out, ckpt)
    whole = D.detect(spark.createDataFrame(pages, schema), cfg)
    for what, want in (("acts", whole.acts), ("mentions", whole.mentions)):
        got = S.detected(spark, out, what)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) != []


def test_admission_by_cycle_hour_and_day(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(200_000)) for i in range(2000)]
    q = QualityConfig(per_cycle=4, calls_per_cycle=3, per_hour=7, per_day=100)
    got = {r["event_id"] for r in J.admitted(spark.createDataFrame([(i, at(t)) for i, t in rows], "event_id bigint, ts timestamp"), q, cycle_minutes=15).collect()}

    def first(events, width, cap):
        seen, out = {}, []
        for t, i in sorted((t, i) for i, t in events):
            seen[t // width] = seen.get(t // width, 0) + 1
            if seen[t // width] <= cap:
                out.append((i, t))
        return out

    assert got == {i for i, _ in first(first(first(rows, 900, 3), 3600, 7), 86_400, 100)}
