"""Structured Streaming jobs; each runs over what has arrived (availableNow) and can be started again from its checkpoint.

The watermarks say how late a row may be: later rows are dropped, and closed windows
and old keys leave the state.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..functions import text as T
from ..plans.inputs import table
from ..sources.staging import new_dir

STEPS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote."""
    spark, out = stream.sparkSession, new_dir(stream.sparkSession, "stream")
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_emails(docs: DataFrame, delay: str = "1 day") -> DataFrame:
    """Arriving texts (doc_id, text, ts): repeated contents inside the delay are dropped, addresses taken out."""
    fresh = docs.withColumn("hash", F.sha2("text", 256)).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["hash"])
    return fresh.select("hash", F.explode(T.emails(F.col("text"))).alias("email"))


def step_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Count and seconds of steps by operation in tumbling or sliding windows."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    agg = events.withWatermark("ts", delay).groupBy(span, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("seconds"))
    return agg.select(F.col("window.start").alias("start"), "event_type", "n", F.round("seconds", 4).alias("seconds"))


def run_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Runs of a user as sessions that an idle gap ends."""
    agg = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return agg.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


#: Kinds of progress events that begin a run, end it, and tell of a failed step.
BEGINS, ENDS, FAILS = "pipeline_start", "pipeline_done", "step_failed"


def fold_run(events: list[tuple[int, int, str]], run: tuple | None, gap: int) -> tuple[list[tuple], tuple | None]:
    """The runs that end within events (time, id, kind, in order), and the one that is open afterwards: (start, last, steps, failed).

    A run ends with its end event, when another one begins (restarted), or when nothing
    came for `gap` (idle).  Events outside a run open one; an end event with no open run
    is a run without steps.
    """
    out = []
    for at, _, kind in events:
        if run and (at - run[1] >= gap or kind == BEGINS):
            out.append((*run, "idle" if at - run[1] >= gap else "restarted"))
            run = None
        start, _, steps, failed = run or (at, at, 0, 0)
        run = (start, at, steps + (kind not in (BEGINS, ENDS)), failed + (kind == FAILS))
        if kind == ENDS:
            out.append((*run, "done"))
            run = None
    return out, run


def _run_steps(gap: int):
    """Events wait in the state until the watermark says that none before them can come; a timer looks again when the next one is due or the open run has been idle."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, run = json.loads(state.get[0]) if state.exists else ([], None)
        if not state.hasTimedOut:
            for pdf in batches:
                waiting += [[int(t.value // 1000), int(i), str(k)] for t, i, k in zip(pdf["ts"], pdf["event_id"], pdf["kind"], strict=True)]
        mark = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        ready = [e for e in waiting if e[0] <= mark]
        waiting = waiting[len(ready) :]
        ended, run = fold_run(ready, run and tuple(run), gap)
        if run and run[1] + gap <= mark and not (waiting and waiting[0][0] - run[1] < gap):
            ended.append((*run, "idle"))
            run = None
        if waiting or run:
            state.update((json.dumps([waiting, run]),))
            due = min([e[0] for e in waiting[:1]] + ([run[1] + gap] if run else []))
            state.setTimeoutTimestamp(max(due // 1000, mark // 1000) + 1)
        elif state.exists:
            state.remove()
        if ended:
            start, last, steps, failed, why = zip(*ended, strict=True)
            times = lambda xs: pd.to_datetime(list(xs), unit="us")
            yield pd.DataFrame({"run_id": [key[0]] * len(ended), "start": times(start), "stop": times(last), "steps": steps, "failed": failed, "ended": why})

    return step


def pipeline_runs(events: DataFrame, gap_seconds: int = 1800, delay: str = "10 minutes") -> DataFrame:
    """Runs told by progress events (run_id, ts, event_id, kind): run_id, start, stop, steps, failed, ended (done, restarted, idle).

    Events are taken in order of time and id, whatever the order in which they arrive;
    those later than `delay` are dropped.  Two runs inside one gap are two runs: an end
    event or a new beginning separates them.  Rows without a run, time or kind are left out.
    """
    sound = events.select("run_id", "ts", "event_id", "kind").where("run_id is not null and ts is not null and kind is not null and event_id is not null").withWatermark("ts", delay)
    out = "run_id long, start timestamp, stop timestamp, steps long, failed long, ended string"
    return sound.groupBy("run_id").applyInPandasWithState(_run_steps(gap_seconds * 1_000_000), out, "held string", "append", "EventTimeTimeout")


def _newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps the newest (ts, status) of one task; a change is written, a task that the watermark has passed is forgotten."""
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(batches)
    at = rows["ts"].max()
    new = (int(at.value // 1000), rows.loc[rows["ts"] == at, "event_type"].max())
    old = state.get if state.exists else None
    if old is None or new > tuple(old):
        state.update(new)
        # a timeout must lie ahead of the watermark
        state.setTimeoutTimestamp(max(new[0] // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [new[1]], "ts": [at]})


def status_changes(events: DataFrame, ttl: str) -> DataFrame:
    """A row (user_id, event_type, ts) whenever a task has a newer status than before.

    Of statuses at one time the last by name counts.  The state has a row for each task
    that is not older than ttl: the watermark trails the newest step by ttl, so older
    steps are dropped and older tasks leave the state.
    """
    timed = events.select("user_id", "event_type", "ts").where("user_id is not null and ts is not null and event_type is not null").withWatermark("ts", ttl)
    return timed.groupBy("user_id").applyInPandasWithState(_newest, "user_id long, event_type string, ts timestamp", "micros long, event_type string", "append", "EventTimeTimeout")


def latest_status(events: DataFrame, ttl: str) -> DataFrame:
    """The newest status of each task; tasks older than ttl at the end are dropped."""
    rows = drained(status_changes(events, ttl)).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_type")).alias("event_type"), F.max("ts").alias("ts"))
    newest = rows.agg(F.max("ts").alias("newest"))
    return rows.crossJoin(F.broadcast(newest)).where(F.expr(f"ts >= newest - interval {ttl}")).select("user_id", "event_type")  # against one row


def _events(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files, in order of time, with a last row that closes the windows before it."""
    path = new_dir(s, "events")
    rows = table(s, d, "events").select(*(c.split()[0] for c in STEPS.split(", ")))
    rows.repartitionByRange(4, "ts").write.parquet(path)
    end = rows.agg(F.max("ts").alias("t")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("t") + F.expr("interval 30 days")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"))
    end.write.mode("append").parquet(path)
    return s.readStream.schema(STEPS).parquet(path)


#: Progress events of users as runs.
_KIND = "CASE WHEN event_id % 7 = 0 THEN 'pipeline_start' WHEN event_id % 11 = 0 THEN 'pipeline_done' WHEN event_id % 13 = 0 THEN 'step_failed' ELSE 'step_done' END"


def _docs(s: SparkSession, d: str) -> DataFrame:
    path = new_dir(s, "arrived")
    table(s, d, "documents").select("doc_id", "text", F.timestamp_seconds(F.col("doc_id") % 3600 + 1700000000).alias("ts")).write.parquet(path)
    return s.readStream.schema("doc_id long, text string, ts timestamp").parquet(path)


QUERIES = {
    "stream_emails": lambda s, d: drained(stream_emails(_docs(s, d))),
    "stream_step_windows": lambda s, d: drained(step_windows(_events(s, d))).where("event_type <> 'end'"),
    "stream_sliding_windows": lambda s, d: drained(step_windows(_events(s, d), "2 hours", "1 hour")).where("event_type <> 'end'"),
    "stream_sessions": lambda s, d: drained(run_sessions(_events(s, d))).where("user_id >= 0"),
    "stream_runs": lambda s, d: drained(pipeline_runs(_events(s, d).select(F.col("user_id").alias("run_id"), "ts", "event_id", F.expr(_KIND).alias("kind")), 86400, "1 hour")).where("run_id >= 0"),
    "stream_task_status": lambda s, d: latest_status(_events(s, d).where("user_id >= 0"), "10 hours"),
}
_EMAILS = "list_sort(list_distinct(list_filter(regexp_extract_all(text, '" + T.EMAIL + "'), lambda e: lower(regexp_extract(e, '\\.([a-zA-Z]+)$', 1)) NOT IN ('abc', 'test', 'invalid', 'localhost', 'example') AND length(regexp_extract(e, '\\.([a-zA-Z]+)$', 1)) <= 5)))"
SQL = {
    "stream_emails": f"SELECT hash, unnest({_EMAILS}) AS email FROM (SELECT sha256(text) AS hash, any_value(text) AS text FROM documents GROUP BY 1)",
    "stream_step_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS seconds FROM events GROUP BY 1, 2",
    "stream_sliding_windows": "SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS seconds FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - o * INTERVAL 1 HOUR AS start, event_type, value FROM events, (SELECT unnest([0, 1]) AS o)) GROUP BY 1, 2",
    "stream_sessions": "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true))::INT AS new FROM events)) GROUP BY user_id, g",
    "stream_runs": f"""
        WITH e AS (SELECT user_id AS run_id, ts, event_id, {_KIND} AS kind FROM events),
        f AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 1 DAY OR lag(kind) OVER w = 'pipeline_done', true) OR kind = 'pipeline_start' AS new, lead(ts) OVER w - ts < INTERVAL 1 DAY AS soon, lead(kind) OVER w AS next FROM e WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)),
        g AS (SELECT *, sum(new::INT) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS g FROM f)
        SELECT run_id, min(ts) AS start, max(ts) AS stop, count(*) FILTER (kind LIKE 'step%') AS steps, count(*) FILTER (kind = 'step_failed') AS failed,
          CASE WHEN bool_or(kind = 'pipeline_done') THEN 'done' WHEN arg_max(soon AND next = 'pipeline_start', (ts, event_id)) THEN 'restarted' ELSE 'idle' END AS ended
        FROM g GROUP BY run_id, g""",
    "stream_task_status": "SELECT user_id, event_type FROM (SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY user_id) WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 HOUR",
}
