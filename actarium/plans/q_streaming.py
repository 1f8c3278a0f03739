"""K-operators: streams run over all available data, batch twins run on the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import QualityConfig
from ..streaming import cooldown as C
from ..streaming import jobs as J
from ..streaming import streams as S
from . import sqlx as Q
from .projections import AS_OF_TS, CONFIG
from .q_detect import ACTS_CTE, FIELDS_CTE, RAW_CTE, _ACOLS
from .registry import query


def _ev(t):
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("K1_stream_editions", """WITH inc AS (SELECT url, CASE WHEN edition_id % 3 = 0 AND n = 2 THEN '' ELSE title || ' v' || n END AS title, CASE WHEN edition_id % 2 = 0 AND n = 2 THEN NULL ELSE '2002-01-0' || n END AS pub_date, n FROM gz_editions, (VALUES (1), (2)) v(n) WHERE n = 1 OR edition_id % 4 > 0)
SELECT url, coalesce(arg_max(title, n) FILTER (title <> ''), '') AS title, arg_max(pub_date, n) FILTER (pub_date IS NOT NULL) AS pub_date FROM inc GROUP BY 1""")
def _(t):
    src, ckpt, tab = t.scratch("intake"), t.scratch("ckpt"), t.scratch("editions")
    e = t.gz_editions
    for n in (1, 2):
        late = F.lit(n == 2)
        part = e if n == 1 else e.where("edition_id % 4 > 0")
        part.select("url", F.when((F.col("edition_id") % 3 == 0) & late, "").otherwise(F.concat("title", F.lit(f" v{n}"))).alias("title"),
                    F.when((F.col("edition_id") % 2 == 0) & late, F.lit(None)).otherwise(F.lit(f"2002-01-0{n}")).alias("pub_date"), F.lit(n).alias("seq")).write.mode("append").parquet(src)
    S.stream_editions(S.read_stream(t.spark, src, "url string, title string, pub_date string, seq int", 4), tab, ckpt)
    return S.edition_table(t.spark, tab).select("url", "title", "pub_date")


@query("K2_stream_detect", f"WITH {FIELDS_CTE}, {ACTS_CTE}, {RAW_CTE} SELECT {_ACOLS} FROM raw WHERE NOT ff")
def _(t):
    src, ckpt, out = t.scratch("pages"), t.scratch("ckpt"), t.scratch("detected")
    p = t.spread("gz_pages")
    for part in range(3):  # three deliveries, each with a third of the pages of every edition
        p.where(F.pmod(F.xxhash64("edition_id", "page"), F.lit(3)) == part).write.mode("append").parquet(src)
    S.stream_detect(S.read_stream(t.spark, src, p.schema, t.parts), CONFIG, out, ckpt)  # about one delivery in a batch
    return S.detected(t.spark, out, "acts")


_COOL = """WITH RECURSIVE r AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1 UNION ALL SELECT user_id, nt FROM (SELECT r.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = r.user_id AND e.ts >= r.ts + INTERVAL 60 MINUTE) AS nt FROM r) WHERE nt IS NOT NULL)
SELECT CAST(user_id AS VARCHAR) AS key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM r"""


@query("K3_cooldown_alerts", _COOL)
def _(t):
    e = _ev(t).select(F.col("user_id").cast("string").alias("key"), "ts")
    return C.cooldown_alerts(e).where("emitted").select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


def _deliveries(t, events, src, parts=4):
    """The events in some files, each a later stretch of time; the files of a stream are read in the order they are written in."""
    ends = events.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    part = F.least(F.floor((F.unix_micros("ts") - ends["a"]) * parts / F.lit(ends["b"] - ends["a"] + 1)), F.lit(parts - 1))
    for i in range(parts):
        events.where(part == i).coalesce(1).write.mode("append").parquet(src)
    return S.read_stream(t.spark, src, events.schema)


@query("K3_cooldown_stream", f"SELECT * FROM ({_COOL}) WHERE CAST(ts AS TIMESTAMP) <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def _(t):
    src, ckpt, out = t.scratch("events"), t.scratch("ckpt"), t.scratch("alerts")
    e = _ev(t).select(F.col("user_id").cast("string").alias("key"), "ts")
    S.to_parquet(C.cooldown_stream(_deliveries(t, e, src)), out, ckpt)
    return t.spark.read.parquet(out).select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query("K4_stuck_jobs", f"""SELECT job_id, CASE WHEN st THEN 'erro' ELSE status END AS status, CASE WHEN st THEN coalesce(message, '') || ' [agente: travado]' ELSE message END AS message, st AS closed
FROM (SELECT *, status = 'rodando' AND updated_at < TIMESTAMP '{AS_OF_TS}' - INTERVAL 30 MINUTE AS st FROM gz_jobs)""")
def _(t):
    return J.stuck_jobs(t.gz_jobs, F.lit(AS_OF_TS).cast("timestamp")).select("job_id", "status", "message", "closed")


@query("K4_interrupted_editions", "SELECT DISTINCT edition_id FROM gz_jobs WHERE status = 'rodando' AND edition_id IS NOT NULL")
def _(t):
    return J.interrupted_editions(t.gz_jobs)


_Q5 = QualityConfig(per_hour=10, per_day=150)


@query("K5_budget_admitted", """WITH h AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS hr FROM events), d AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS dr FROM h WHERE hr <= 10)
SELECT event_id, CAST(hr AS INTEGER) AS hour_rank, CAST(dr AS INTEGER) AS day_rank FROM d WHERE dr <= 150""")
def _(t):
    return J.admitted(_ev(t).select("event_id", "ts"), _Q5).select("event_id", "hour_rank", "day_rank")


@query("K5_budget_cycles", """WITH c AS (SELECT *, row_number() OVER (PARTITION BY time_bucket(INTERVAL 20 MINUTE, ts) ORDER BY ts, event_id) AS cr FROM events),
h AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS hr FROM c WHERE cr <= 3), d AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS dr FROM h WHERE hr <= 7)
SELECT event_id, CAST(cr AS INTEGER) AS cycle_rank, CAST(hr AS INTEGER) AS hour_rank, CAST(dr AS INTEGER) AS day_rank FROM d WHERE dr <= 120""")
def _(t):
    q = QualityConfig(per_cycle=5, calls_per_cycle=3, per_hour=7, per_day=120)
    return J.admitted(_ev(t).select("event_id", "ts"), q, cycle_minutes=20).select("event_id", "cycle_rank", "hour_rank", "day_rank")


@query("K5_budget_left", f"""SELECT h AS hour_used, d AS day_used, least(5, greatest(0, 15 - h), greatest(0, 4000 - d)) AS admit FROM (SELECT count(*) FILTER (date_trunc('hour', ts) = TIMESTAMP '{AS_OF_TS}') AS h, count(*) FILTER (date_trunc('day', ts) = TIMESTAMP '2024-01-30') AS d FROM events)""")
def _(t):
    return J.budget_left(_ev(t), F.lit(AS_OF_TS).cast("timestamp"), QualityConfig(per_day=4000))


@query("K6_liveness", f"""SELECT CAST(user_id AS VARCHAR) AS process, hb AS heartbeat_age, cy AS cycle_age, coalesce(hb <= 180, false) OR coalesce(cy <= 600, false) AS alive FROM (
  SELECT user_id, CAST(epoch(TIMESTAMP '{AS_OF_TS}') - floor(epoch(max(ts) FILTER (event_type IN ('view', 'click')))) AS BIGINT) AS hb, CAST(epoch(TIMESTAMP '{AS_OF_TS}') - floor(epoch(max(ts) FILTER (event_type NOT IN ('view', 'click')))) AS BIGINT) AS cy FROM events WHERE ts <= TIMESTAMP '{AS_OF_TS}' GROUP BY 1)""")
def _(t):
    e = _ev(t).select(F.col("user_id").cast("string").alias("process"), F.when(F.col("event_type").isin("view", "click"), "heartbeat").otherwise("cycle").alias("kind"), "ts")
    return J.liveness(e, F.lit(AS_OF_TS).cast("timestamp"))


_ALIVE = """WITH h AS (SELECT CAST(user_id AS VARCHAR) AS process, ts, ts + CASE WHEN event_type IN ('view', 'click') THEN INTERVAL 180 SECOND ELSE INTERVAL 600 SECOND END AS fin FROM events),
b AS (SELECT *, max(fin) OVER (PARTITION BY process ORDER BY ts, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM h),
g AS (SELECT *, sum(CASE WHEN open IS NULL OR ts > open THEN 1 ELSE 0 END) OVER (PARTITION BY process ORDER BY ts, fin) AS s FROM b)
SELECT process, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(fin), '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS beats FROM g GROUP BY process, s"""


def _signs(t):
    return _ev(t).select(F.col("user_id").cast("string").alias("process"), F.when(F.col("event_type").isin("view", "click"), "heartbeat").otherwise("cycle").alias("kind"), "ts")


def _written_sessions(df):
    return df.select("process", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("start", "end")], "beats")


@query("K6_alive_sessions", _ALIVE)
def _(t):
    return _written_sessions(J.alive_sessions(_signs(t)))


@query("K6_alive_stream", f"""SELECT * FROM ({_ALIVE}) WHERE CAST("end" AS TIMESTAMP) <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def _(t):
    src, ckpt, out = t.scratch("signs"), t.scratch("ckpt"), t.scratch("alive")
    S.stream_alive(_deliveries(t, _signs(t), src), out, ckpt)
    return _written_sessions(t.spark.read.parquet(out))


@query("K7_failure_quarantine", """WITH a AS (SELECT user_id, event_id, event_type = 'purchase' AS ok, props FROM events), l AS (SELECT user_id, max(event_id) FILTER (ok) AS lo FROM a GROUP BY 1),
f AS (SELECT a.user_id, count(*) AS n, arg_max(props, event_id) AS m FROM a JOIN l USING (user_id) WHERE NOT ok AND (lo IS NULL OR event_id > lo) GROUP BY 1)
SELECT l.user_id AS key, coalesce(n, 0) AS failures, m AS last_message, coalesce(n, 0) >= 3 AS quarantined FROM l LEFT JOIN f USING (user_id)""")
def _(t):
    a = t.events.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("ok"), F.col("props").alias("message"))
    return J.failure_counts(a)


@query("K7_release", "SELECT edition_id, CASE WHEN failures >= 3 THEN 0 ELSE failures END AS failures, CASE WHEN failures >= 3 THEN NULL ELSE failure_msg END AS failure_msg FROM gz_editions")
def _(t):
    return J.release(t.gz_editions, t.gz_editions.where("failures >= 3")).select("edition_id", "failures", "failure_msg")


_OK = "(event_type <> 'error')"
_HIT = "(event_type IN ('purchase', 'click'))"


def _streak(flag: str) -> str:
    return f"""(SELECT coalesce(max(c), 0) FROM (SELECT count(*) AS c FROM (SELECT {flag} AS f, sum(CASE WHEN {flag} THEN 0 ELSE 1 END) OVER (ORDER BY event_id) AS g FROM events) WHERE f GROUP BY g))"""


def _cur(flag: str) -> str:
    return f"(SELECT count(*) FROM events WHERE event_id > coalesce((SELECT max(event_id) FROM events WHERE NOT {flag}), -1))"


@query("K8_run_stats", f"""WITH a AS (SELECT count(*) FILTER ({_OK}) AS processed, count(*) FILTER (NOT {_OK}) AS failures, count(*) FILTER ({_HIT}) AS hits, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS el FROM events),
m AS (SELECT avg(value) AS mv FROM (SELECT value FROM events WHERE {_OK} ORDER BY event_id DESC LIMIT 20))
SELECT processed, failures, hits, round(processed / (el / 3600), 2) AS per_hour, round(mv, 3) AS mean_seconds, round(mv * 100, 1) AS eta_seconds, round(100.0 * hits / processed, 2)::DOUBLE AS hit_rate, {_streak(_OK)} AS best_ok, {_cur(_OK)} AS current_ok, {_streak(_HIT)} AS best_hit, {_cur(_HIT)} AS current_hit FROM a, m""")
def _(t):
    r = _ev(t).select(F.col("event_id").alias("seq"), "ts", (F.col("event_type") != "error").alias("ok"), F.col("event_type").isin("purchase", "click").alias("hit"), F.col("value").alias("seconds"))
    return J.run_stats(r, 100)


_WIN = "SELECT strftime(date_trunc('hour', updated_at), '%Y-%m-%d %H:%M:%S') AS start, status, count(*) AS n FROM gz_jobs GROUP BY ALL"


@query("K9_job_windows", _WIN)
def _(t):
    return J.job_windows(t.gz_jobs).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "status", "n")


@query("K9_job_windows_stream", f"SELECT * FROM ({_WIN}) WHERE CAST(start AS TIMESTAMP) + INTERVAL 1 HOUR <= (SELECT max(updated_at) FROM gz_jobs) - INTERVAL 10 MINUTE")
def _(t):
    src, ckpt, out = t.scratch("jobs"), t.scratch("ckpt"), t.scratch("windows")
    j = t.gz_jobs
    j.write.parquet(src)
    S.stream_job_windows(S.read_stream(t.spark, src, j.schema, 1000), out, ckpt)
    return t.spark.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "status", "n")


@query("K10_stream_mentions_once", f"SELECT DISTINCT edition_id, md5(CAST(page AS VARCHAR) || '|' || {Q.squeeze('excerpt')}) AS hash FROM gz_mentions")
def _(t):
    src, ckpt, out = t.scratch("mentions"), t.scratch("ckpt"), t.scratch("once")
    m = t.spread("gz_mentions").select("edition_id", "page", "excerpt", F.lit(AS_OF_TS).cast("timestamp").alias("seen_at"))
    for part in (m, m.where("page % 2 = 0")):  # the second delivery repeats half of the first
        part.write.mode("append").parquet(src)
    S.to_parquet(S.mentions_once(S.read_stream(t.spark, src, m.schema, t.parts)).select("edition_id", "hash"), out, ckpt)
    return t.spark.read.parquet(out)


@query("K11_night_budget", """SELECT event_id, hour(ts) >= 22 OR hour(ts) < 6 AS night, CAST(least(CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 3 ELSE 1 END, greatest(0, 40 - user_id)) AS BIGINT) AS allowed FROM events""")
def _(t):
    e = _ev(t)
    return e.select("event_id", J.is_night(F.col("ts")).alias("night"), J.night_budget(F.col("ts"), 1, F.col("user_id")).cast("bigint").alias("allowed"))
