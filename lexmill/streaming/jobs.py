"""Job events: marker lines, folds of state, session pauses and the review gate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lexmill.sources.store import Store

MARKERS = {
    "start": r"^\s*ARTICLE_START:\s*(\S+)\s*$",
    "complete": r"^\s*ARTICLE_COMPLETE:\s*(\S+)\s*$",
    "error": r"^\s*ARTICLE_ERROR:\s*(\S+)(?:\s+-\s+(.*))?$",
    "batch_complete": r"^\s*BATCH_COMPLETE\b",
}


def parse_markers(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with event_type, slug and message; lines without a marker are left out. Slugs may have
    hyphens: a reason begins after ' - '."""
    c = F.col(value)
    kind = F.coalesce(*[F.when(c.rlike(p), k) for k, p in MARKERS.items()])
    slug = F.coalesce(*[F.nullif(F.regexp_extract(c, MARKERS[k], 1), F.lit("")) for k in ("start", "complete", "error")])
    message = F.nullif(F.regexp_extract(c, MARKERS["error"], 2), F.lit(""))
    return lines.withColumns({"event_type": kind, "slug": slug, "message": message}).where("event_type is not null")


def job_state(events: DataFrame, job: str = "job_id", kind: str = "event_type", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """(job, status, processed, errors, last_slug) folded from events: terminal events decide, else
    the job runs once anything started. Works on a stream too (complete or update mode)."""
    at = F.struct(ts, tie)
    k = F.col(kind)
    return events.groupBy(job).agg(
        F.count_if(k == "complete").alias("processed"), F.count_if(k == "error").alias("errors"),
        F.coalesce(F.max_by(F.when(k == "batch_complete", "completed").when(k == "cancel", "cancelled").when(k == "fail", "failed"), F.when(k.isin("batch_complete", "cancel", "fail"), at)), F.when(F.count_if(k.isin("start", "complete", "error")) > 0, "running"), F.lit("pending")).alias("status"),
        F.max_by("slug", F.when(k == "start", at)).alias("last_slug"),
    )


def job_rows(moves: DataFrame) -> DataFrame:
    """Rows of jobs after moves(id, seq, ts, move): insert, run, progress, complete, fail, cancel.
    `run` sets started_at once, a final move completed_at, and each progress counts one more."""
    move, final = F.col("move"), F.col("move").isin("complete", "fail", "cancel")
    ends = F.when(move == "complete", "completed").when(move == "fail", "failed").when(move == "cancel", "cancelled")
    status = F.coalesce(F.max_by(ends, F.when(final, F.col("seq"))), F.when(F.count_if(move == "run") > 0, "running"), F.lit("pending"))
    times = [F.min(F.when(move == "run", F.col("ts"))).alias("started_at"), F.max(F.when(final, F.col("ts"))).alias("completed_at")]
    return moves.groupBy("id").agg(status.alias("status"), F.count_if(move == "progress").alias("processed_count"), *times)


def start_errors(jobs: DataFrame, count: Column) -> DataFrame:
    """(error): why a job may not start now, or null: one runs, or the count is not from 1 to 50."""
    return jobs.agg(F.count_if(F.col("status") == "running").alias("n")).select(F.when((count < 1) | (count > 50), "INVALID_COUNT").when(F.col("n") > 0, "ALREADY_RUNNING").alias("error"))


def cancel(jobs: DataFrame, job_id) -> DataFrame:
    """jobs with the job cancelled if it is running."""
    hit = (F.col("id") == job_id) & (F.col("status") == "running")
    return jobs.withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status")))


def session_pauses(saves: DataFrame, who: str, ts: str, tie: str, interval: int = 5) -> DataFrame:
    """saves with number_today and pause: every interval-th save of a day asks for review, and the
    count starts anew each day."""
    day = Window.partitionBy(who, F.to_date(ts)).orderBy(ts, tie)
    return saves.withColumn("number_today", F.row_number().over(day).cast("long")).withColumn("pause", F.col("number_today") % interval == 0)


def session_limit(state: DataFrame, today: Column) -> DataFrame:
    """state with limit_reached; a new day resets the count first."""
    stale = ~F.col("last_reset_date").eqNullSafe(today)
    out = state.withColumn("articles_processed_count", F.when(stale, 0).otherwise(F.col("articles_processed_count"))).withColumn("last_reset_date", today)
    return out.withColumn("limit_reached", F.col("articles_processed_count") >= F.col("human_review_interval"))


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", kind: str = "event_type", save: str = "purchase", reset: str = "signup", interval: int = 5) -> DataFrame:
    """(key, articles_processed_count, human_review_interval, last_reset_at, last_reset_date) of each key's
    session after its events: saves of the last day with any, after the last reset. Days begin anew."""
    last = events.groupBy(key).agg(F.max(F.when(F.col(kind) == save, F.to_date(ts))).alias("last_reset_date"), F.max(F.when(F.col(kind) == reset, F.col(ts))).alias("last_reset_at"))
    saves = events.where(F.col(kind) == save).select(F.col(key).alias("of"), F.col(ts).alias("at"))
    counted = (F.to_date("at") == F.col("last_reset_date")) & (F.col("last_reset_at").isNull() | (F.col("at") > F.col("last_reset_at")))
    n = saves.join(last, F.col("of").eqNullSafe(F.col(key))).where(counted).groupBy("of").agg(F.count("*").alias("n"))
    out = last.join(n, F.col(key).eqNullSafe(F.col("of")), "left")
    return out.select(key, F.coalesce("n", F.lit(0)).cast("int").alias("articles_processed_count"), F.lit(interval).alias("human_review_interval"), "last_reset_at", "last_reset_date")


STEPS = ("fields", "warnings", "references", "formulas")
OUTCOME = "doc_id string, seq long, event string, outcome string, done string"


def advance(done: set[str], checked: set[str], event: str, ok: bool) -> str:
    """One event of the review gate: check:<step>, confirm:<step>, complete or reset."""
    verb, _, step = event.partition(":")
    if verb == "reset":
        done.clear()
        checked.clear()
        return "ok"
    if verb == "complete":
        return "ok" if done == set(STEPS) else "INCOMPLETE_CHECKS"
    if step not in STEPS or any(s not in done for s in STEPS[: STEPS.index(step)]):
        return "PREREQUISITE_MISSING"
    if verb == "check":
        checked.add(step)
        return "ok"
    if step not in checked:
        return "PREREQUISITE_MISSING"
    if not ok:
        return "ISSUES_NOT_ADDRESSED"
    done.add(step)
    return "ok"


def review_gate(events: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(doc_id, seq, event, outcome, done) of events(doc_id, seq, event, ok), in order of seq (or of the
    columns given). Documents are sorted, and folded row by row: none is held whole."""
    rows = events.select("doc_id", "seq", "event", "ok", *[c for c in order if c != "seq"])
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", *order).select("doc_id", "seq", "event", "ok")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None
        done: set[str] = set()
        checked: set[str] = set()
        for frame in frames:
            out = []
            for doc, seq, event, ok in zip(frame["doc_id"], frame["seq"], frame["event"], frame["ok"], strict=True):
                if last != (doc,):
                    last, done, checked = (doc,), set(), set()
                outcome = advance(done, checked, event, bool(ok))
                out.append((doc, seq, event, outcome, ",".join(s for s in STEPS if s in done)))
            yield pd.DataFrame(out, columns=["doc_id", "seq", "event", "outcome", "done"])

    return rows.mapInPandas(run, OUTCOME)


#: How late an event may come, and how long a document without events is remembered.
LATE, REMEMBERED = "10 minutes", "30 days"


class GateProcessor(StatefulProcessor):
    """The review gate of one document over micro-batches, in event time.

    Events wait until the watermark has passed them, and are then taken in order of time and seq, so
    that an event which arrives late or out of order within the watermark counts where it belongs. What
    is kept of a document is its waiting events and the steps done and checked; a document without
    events for `remembered` milliseconds of event time is forgotten, and begins anew."""

    def __init__(self, remembered: int) -> None:
        self.remembered = remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, event string, ok boolean")
        self.state = handle.getValueState("state", "done string, checked string, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        at = frame["ts"].astype("datetime64[us, UTC]" if getattr(frame["ts"].dtype, "tz", None) is not None else "datetime64[us]").astype("int64") // 1000
        new = [(int(a), int(s), e, bool(ok)) for a, s, e, ok in zip(at, frame["seq"], frame["event"], frame["ok"], strict=True)]
        self.waiting.appendList(new)
        due = max(min(a for a, *_ in new), timerValues.getCurrentWatermarkInMs()) + 1
        if all(t > due for t in self.handle.listTimers()):
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in waiting if r[0] < now], [r for r in waiting if r[0] >= now]
        done, checked, last = self.state.get() if self.state.exists() else ("", "", 0)
        done, checked = set(done.split(",")) - {""}, set(checked.split(",")) - {""}
        rows = []
        for at, seq, event, ok in due:
            if last and at - last >= self.remembered:
                done, checked = set(), set()
            outcome = advance(done, checked, event, ok)
            rows.append((key[0], seq, event, outcome, ",".join(s for s in STEPS if s in done)))
            last = at
        if not rest and now - last >= self.remembered:
            self.waiting.clear()
            self.state.clear()
        else:
            self.state.update((",".join(sorted(done)), ",".join(sorted(checked)), last))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            self.handle.registerTimer(rest[0][0] + 1 if rest else last + self.remembered)
        if rows:
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "event", "outcome", "done"])

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State of streams in RocksDB, which the review gate needs and which need not fit in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def review_gate_stream(events: DataFrame, late: str = LATE, remembered: str = REMEMBERED) -> DataFrame:
    """The same on a stream of events(doc_id, ts, seq, event, ok), by event time: equal to review_gate by
    (ts, seq) over all events that are at most `late` behind the newest one seen. An outcome comes when the
    watermark has passed its event. Needs use_rocksdb."""
    ms = int(pd.Timedelta(remembered).total_seconds() * 1000)
    kept = events.select("doc_id", "ts", "seq", "event", "ok").withWatermark("ts", late)
    return kept.groupBy("doc_id").transformWithStateInPandas(GateProcessor(ms), OUTCOME, "Append", "EventTime")


def start_to_end(stream: DataFrame, path: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Write all that a stream has by now to Parquet, exactly once over restarts, and stop."""
    return stream.writeStream.format("parquet").options(**options).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def poll(stream: DataFrame, store: Store, name: str, key: list[str], checkpoint: str, every: str | None = None, order: str = "ts") -> StreamingQuery:
    """Keep the table `name` of a store up to date with the newest row of each key of a stream: each
    micro-batch is upserted, into the buckets it touches, in one snapshot that also records the batch's
    number, so a batch that is run again after a crash changes nothing. Without `every` (a trigger interval such as "5 seconds")
    it takes what there is and stops."""

    def apply(batch: DataFrame, number: int) -> None:
        mark = f"{name}_batch"
        if mark in store.manifest() and (store.read(mark).agg(F.max("batch")).first()[0] or 0) > number:
            return  # published before a crash
        done = batch.sparkSession.createDataFrame([(number + 1,)], "batch long")
        store.upsert(name, batch, key, also={mark: done}, newest_by=order)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", size: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Extension: events by window and type, late ones within `late` included."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def read_event_stream(spark, path: str, schema) -> DataFrame:
    """Extension: a folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def step_progress(done: Column, target: Column) -> Column:
    return F.concat((done + 1).cast("string"), F.lit("/"), target.cast("string"))
