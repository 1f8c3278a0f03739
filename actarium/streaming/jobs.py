"""K4-K9, K11 - budgets, liveness, stuck jobs, quarantine and run statistics over event tables (batch twins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import QualityConfig
from ..functions.text import text
from ..operators.quality import one_row
from ..operators.windows import CHUNK

def stuck_jobs(jobs: DataFrame, as_of: Column, max_minutes: int = 30) -> DataFrame:
    """K4 - running rows not updated within the limit become errors; a limit of 0 closes all running rows."""
    run = F.col("status") == "rodando"
    stuck = run if max_minutes <= 0 else run & (F.col("updated_at") < as_of - F.expr(f"INTERVAL {max_minutes} MINUTES"))
    msg = F.lit("Job interrompido - servidor reiniciado") if max_minutes <= 0 else F.concat(text("message"), F.lit(" [agente: travado]"))
    return jobs.withColumns({
        "status": F.when(stuck, "erro").otherwise(F.col("status")), "message": F.when(stuck, msg).otherwise(F.col("message")),
        "updated_at": F.when(stuck, as_of).otherwise(F.col("updated_at")), "closed": stuck})


def interrupted_editions(jobs: DataFrame) -> DataFrame:
    """K4 - editions with a running row."""
    return jobs.where("status = 'rodando' and edition_id is not null").select("edition_id").distinct()


def admitted(events: DataFrame, q: QualityConfig = QualityConfig(), cycle_minutes: int | None = None) -> DataFrame:
    """K5 - events admitted under the caps, in order of time. Input: event_id, ts.

    Within a cycle (tumbling windows of ``cycle_minutes``, if given) the first ``per_cycle`` are candidates (no more than
    ``calls_per_cycle``, if that is above 0), of an hour's candidates the first ``per_hour``, and of a day's candidates the
    first ``per_day`` pass. All ranks are limits, so they are applied before the shuffle and no bucket is gathered."""
    def first(df: DataFrame, bucket: Column, cap: int, name: str) -> DataFrame:
        w = Window.partitionBy(bucket).orderBy("ts", "event_id")
        return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= max(0, cap))

    c = events
    if cycle_minutes is not None:
        c = first(c, F.window("ts", f"{cycle_minutes} minutes")["start"], cycle_cap(q), "cycle_rank")
    c = first(c, F.date_trunc("hour", "ts"), q.per_hour, "hour_rank")
    return first(c, F.date_trunc("day", "ts"), q.per_day, "day_rank")


def cycle_cap(q: QualityConfig) -> int:
    """K5 - how many may start in a cycle."""
    return min(q.per_cycle, q.calls_per_cycle) if q.calls_per_cycle > 0 else q.per_cycle


def budget_left(calls: DataFrame, as_of: Column, q: QualityConfig = QualityConfig()) -> DataFrame:
    """K5 - how many may start now: the least of the cycle cap and what hour and day have left."""
    n = calls.agg(F.count_if(F.date_trunc("hour", "ts") == F.date_trunc("hour", as_of)).alias("hour_used"),
                  F.count_if(F.date_trunc("day", "ts") == F.date_trunc("day", as_of)).alias("day_used"))
    left = F.least(F.lit(max(0, cycle_cap(q))).cast("bigint"), F.greatest(F.lit(0), q.per_hour - F.col("hour_used")), F.greatest(F.lit(0), q.per_day - F.col("day_used")))
    return n.withColumn("admit", left)


def liveness(heartbeats: DataFrame, as_of: Column, q: QualityConfig = QualityConfig()) -> DataFrame:
    """K6 - per process: alive if the last heartbeat is recent, or the last finished cycle is. Input: process, kind, ts."""
    g = heartbeats.where(F.col("ts") <= as_of).groupBy("process").agg(
        F.max(F.when(F.col("kind") == "heartbeat", F.col("ts"))).alias("hb"), F.max(F.when(F.col("kind") == "cycle", F.col("ts"))).alias("cy"))

    def age(c: str) -> Column:
        return F.unix_timestamp(as_of) - F.unix_timestamp(c)

    alive = F.coalesce(age("hb") <= q.heartbeat_seconds, F.lit(False)) | F.coalesce(age("cy") <= q.cycle_seconds, F.lit(False))
    return g.select("process", age("hb").alias("heartbeat_age"), age("cy").alias("cycle_age"), alive.alias("alive"))


def alive_sessions(heartbeats: DataFrame, q: QualityConfig = QualityConfig(), watermark: str | None = None) -> DataFrame:
    """K6 - the stretches of time in which a process counted as alive: (process, start, end, beats).

    Every sign of life opens a session window as long as its kind keeps a process alive; sessions that touch are one, and
    the end is when the process is found dead unless a later sign comes. The same expression serves batch and stream; a
    stream needs a watermark and gives a session once nothing can be added to it."""
    h = heartbeats.where(F.col("kind").isin("heartbeat", "cycle"))
    h = h.withWatermark("ts", watermark) if watermark else h
    lasting = F.when(F.col("kind") == "heartbeat", F.lit(f"{q.heartbeat_seconds} seconds")).otherwise(F.lit(f"{q.cycle_seconds} seconds"))
    g = h.groupBy(F.session_window("ts", lasting).alias("w"), "process").agg(F.count("*").alias("beats"))
    return g.select("process", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")


def failure_counts(attempts: DataFrame, q: QualityConfig = QualityConfig()) -> DataFrame:
    """K7 - failures since the last success per key, and who is in quarantine. Input: key, seq, ok, message.

    Two aggregates (the last success, then the failures after it), each combined before its shuffle; no key is sorted."""
    last = attempts.groupBy("key").agg(F.max(F.when(F.col("ok"), F.col("seq"))).alias("last_ok"))
    f = attempts.where(~F.col("ok")).join(last, "key").where(F.col("last_ok").isNull() | (F.col("seq") > F.col("last_ok")))
    n = f.groupBy("key").agg(F.count("*").alias("failures"), F.max_by("message", "seq").alias("last_message"))
    return last.join(n, "key", "left").select("key", F.coalesce("failures", F.lit(0).cast("bigint")).alias("failures"), "last_message",
                                              (F.coalesce("failures", F.lit(0)) >= q.quarantine_failures).alias("quarantined"))


def release(editions: DataFrame, released: DataFrame) -> DataFrame:
    """K7 - taken out of quarantine: the counters are cleared."""
    j = editions.join(released.select("edition_id").distinct().withColumn("_hit", F.lit(True)), "edition_id", "left")
    return j.withColumns({"failures": F.when(F.col("_hit"), 0).otherwise(F.col("failures")).cast("int"),
                          "failure_msg": F.when(F.col("_hit"), None).otherwise(F.col("failure_msg"))}).drop("_hit")


_RUN = "struct<n:bigint,before:bigint,after:bigint,best:bigint>"


def _joined(a: Column, b: Column) -> Column:
    """Two neighbouring stretches as one: length, run at the start, run at the end, longest run."""
    return F.struct(
        (a["n"] + b["n"]).alias("n"), F.when(a["before"] == a["n"], a["n"] + b["before"]).otherwise(a["before"]).alias("before"),
        F.when(b["after"] == b["n"], b["n"] + a["after"]).otherwise(b["after"]).alias("after"),
        F.greatest(a["best"], b["best"], a["after"] + b["before"]).alias("best"))


def streaks(df: DataFrame, order: str, flag: Column, chunk: int = CHUNK, fan: int = 64) -> DataFrame:
    """Longest and current run of rows with ``flag`` in order of a unique integer column: (best, current) in one row.

    The sequence is cut into chunks of ``chunk`` ids, each summed up by its length, the runs at its ends and its longest
    run. Neighbouring summaries join associatively, so they are merged in a tree, ``fan`` of them at a time."""
    d = df.select(F.floor(F.col(order) / chunk).cast("bigint").alias("_c"), F.col(order).alias("_o"), flag.alias("_f"))
    w = Window.partitionBy("_c").orderBy("_o")
    d = d.withColumn("_p", F.row_number().over(w))
    brk = F.when(~F.coalesce("_f", F.lit(False)), F.col("_p"))
    d = d.withColumn("_since", F.col("_p") - F.coalesce(F.max(brk).over(w), F.lit(0)))
    n = F.count("*")
    s = d.groupBy("_c").agg(F.struct(n.alias("n"), F.coalesce(F.min(brk) - 1, n).alias("before"), F.coalesce(n - F.max(brk), n).alias("after"),
                                     F.max("_since").alias("best")).cast(_RUN).alias("r"))
    ends = df.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    low, high = (ends["a"] // chunk, ends["b"] // chunk) if ends["a"] is not None else (0, 0)
    while low != high:
        low, high = low // fan, high // fan
        parts = F.transform(F.array_sort(F.collect_list(F.struct("_c", "r"))), lambda x: x["r"])
        s = s.groupBy(F.floor(F.col("_c") / fan).cast("bigint").alias("_up")).agg(parts.alias("all")).select(
            F.col("_up").alias("_c"), F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.get("all", F.lit(0)), lambda a, b: _joined(a, b).cast(_RUN)).alias("r"))
    return s.agg(F.coalesce(F.max("r.best"), F.lit(0)).alias("best"), F.coalesce(F.max("r.after"), F.lit(0)).alias("current"))


def run_stats(results: DataFrame, pending: int, last: int = 20) -> DataFrame:
    """K8 - one row: throughput per hour, mean of the last durations, remaining time, hit rate and streaks. Input: seq, ts,
    ok, hit, seconds."""
    a = results.agg(F.count_if("ok").alias("processed"), F.count_if(~F.col("ok")).alias("failures"), F.count_if(F.col("ok") & F.col("hit")).alias("hits"),
                    (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("elapsed"))
    m = results.where("ok").orderBy(F.desc("seq")).limit(last).agg(F.avg("seconds").alias("mean_seconds"))
    ok = streaks(results, "seq", F.col("ok")).toDF("best_ok", "current_ok")
    hit = streaks(results.where("ok or not ok"), "seq", F.col("ok") & F.col("hit")).toDF("best_hit", "current_hit")
    r = one_row(a, m, ok, hit)
    return r.select(
        "processed", "failures", "hits", F.round(F.when(F.col("elapsed") >= 30, F.col("processed") / (F.col("elapsed") / 3600)), 2).alias("per_hour"),
        F.round("mean_seconds", 3).alias("mean_seconds"), F.round(F.col("mean_seconds") * pending, 1).alias("eta_seconds"),
        F.round(F.when(F.col("processed") > 0, 100.0 * F.col("hits") / F.col("processed")), 2).alias("hit_rate"), "best_ok", "current_ok", "best_hit", "current_hit")


def job_windows(jobs: DataFrame, width: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """K9 - rows per event-time window and status; the same expression serves batch and stream."""
    j = jobs.withWatermark("updated_at", watermark) if watermark else jobs
    return j.groupBy(F.window("updated_at", width).alias("w"), "status").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "status", "n")


def is_night(ts: Column, q: QualityConfig = QualityConfig()) -> Column:
    """K11 - hour test that may wrap around midnight."""
    h, a, b = F.hour(ts), q.night_start % 24, q.night_end % 24
    if a == b:
        return F.lit(False)
    return (h >= a) & (h < b) if a < b else (h >= a) | (h < b)


def night_budget(ts: Column, base: int, used_today: Column, mode: str = "auto", q: QualityConfig = QualityConfig(), day_cap: int = 40) -> Column:
    """K11 - readings allowed now: multiplied at night for the modes that work then, bounded by what the day has left."""
    base = {"cirurgiao": min(base, 1), "formiga": max(1, base)}.get(mode, max(0, base))
    night = max(base, base * q.night_factor if base else q.night_factor) if mode in ("formiga", "auto", "cirurgiao") else base
    n = F.when(is_night(ts, q), night).otherwise(base)
    return F.least(n, F.greatest(F.lit(0), day_cap - used_today)) if day_cap > 0 else n
