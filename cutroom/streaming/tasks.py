"""Structured Streaming forms of the task-state operators; each gives its batch form's answer on the same events."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cutroom.operators import tasks
from cutroom.sources.folders import delete_path, path_exists


def latest_task_state(updates: DataFrame, by: str = "task_id") -> DataFrame:
    """ST-1 as a stream, for update or complete mode. It keeps one row for each task, as the table of tasks does."""
    return tasks.latest_task_state(updates, by)


#: Buckets of a table of states; a batch rewrites those that its tasks are in.
BUCKETS = 16


def states(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The table that ``upsert_states`` keeps: of each bucket the newest version (of those before a batch), with bucket and version."""
    rows = spark.read.parquet(path)
    rows = rows if before is None else rows.where(F.col("version") < before)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))  # a row for each bucket
    return rows.join(F.broadcast(newest), ["bucket", "version"])


def upsert_states(path: str, by: str = "task_id", order: tuple[str, ...] = ("ts", "event_id"), buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """ST-1's sink for ``foreachBatch``: the last update of each task replaces its record in the table below ``path``.

    A batch writes its buckets anew under its own number, from the versions before it, so a batch that is repeated after a
    failure writes the same again, and a reader sees a bucket's old version until the new one is whole. Of the versions
    before, the newest stays for a repeat. Updates may come late: a record only gives way to a later one.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        values = [c for c in batch.columns if c not in (by, *order)]
        bucket = F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")
        batch = batch.persist()
        fresh = batch.select(by, *order, *values).withColumn("bucket", bucket)
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # ``buckets`` rows at most
        if touched:
            rows = fresh
            if path_exists(spark, path):
                old = states(spark, path, number).where(F.col("bucket").isin(touched))
                rows = old.select(*fresh.columns).unionByName(fresh)
            last = rows.groupBy(by, "bucket").agg(F.max(F.struct(*order, *values)).alias("l")).select(by, "l.*", "bucket").withColumn("version", F.lit(number).cast("long"))
            last.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)
            kept = spark.read.parquet(path).where((F.col("version") < number) & F.col("bucket").isin(touched)).select("bucket", "version").distinct().collect()  # two for each bucket
            for b in touched:
                for v in sorted(r["version"] for r in kept if r["bucket"] == b)[:-1]:
                    delete_path(spark, f"{path}/bucket={b}/version={v}")
        batch.unpersist()

    return write


def accepted_claims(claims: DataFrame, by: str = "task_id", stage: str = "stage", ts: str = "ts", horizon: str | None = None) -> DataFrame:
    """ST-2 as a stream of the accepted claims alone.

    Once only, whenever a claim comes again: a key is kept for each claimed stage for good. With a ``horizon``, keys go
    once the watermark is so far past them, and the same claim is accepted again after that.
    """
    if horizon is None:
        return claims.dropDuplicates([by, stage])
    return claims.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([by, stage])


def claim_once_ledger(claims: DataFrame, by: str = "task_id", stage: str = "stage") -> DataFrame:
    """ST-2 as a stream of all claims with their verdict, in arrival order of micro-batches, by time within one."""
    schema = T.StructType([claims.schema[by], claims.schema[stage], claims.schema["event_id"], T.StructField("accepted", T.BooleanType())])

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        taken = state.exists
        state.update((True,))
        yield pd.DataFrame({by: rows[by], stage: rows[stage], "event_id": rows["event_id"], "accepted": [not taken and n == 0 for n in range(len(rows))]})

    return claims.groupBy(by, stage).applyInPandasWithState(judge, schema, T.StructType([T.StructField("taken", T.BooleanType())]), "append", GroupStateTimeout.NoTimeout)


def stale_runs(events: DataFrame, slot: str = "slot", stale: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """ST-4 as a stream: a slot that has no event for so long is flagged, by event time."""
    schema = T.StructType([events.schema[slot], T.StructField("last_ts", T.TimestampType())])
    wait = int(pd.Timedelta(stale).total_seconds() * 1000)

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({slot: [key[0]], "last_ts": [pd.Timestamp(last, unit="ms")]})
            return
        last = max([int(f["ts"].max().value // 10**6) for f in frames] + ([state.get[0]] if state.exists else []))
        state.update((last,))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)

    rows = events.withWatermark("ts", delay)
    return rows.groupBy(slot).applyInPandasWithState(watch, schema, T.StructType([T.StructField("last", T.LongType())]), "append", GroupStateTimeout.EventTimeTimeout)


def _in_time(state: GroupState, frames: Iterator[pd.DataFrame], at: str, columns: list[str]) -> tuple[dict, list[list]]:
    """A key's memory and the rows whose time the watermark has passed, in order; the others wait in the memory."""
    memory = json.loads(state.get[0]) if state.exists else {"waits": []}
    mark = state.getCurrentWatermarkMs()
    if not state.hasTimedOut:
        for frame in frames:
            times = [int(x.value // 10**6) for x in frame[at]]
            rows = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
            memory["waits"] += [[t, *r] for t, r in zip(times, rows, strict=True)]
    due = sorted((r for r in memory["waits"] if r[0] < mark), key=lambda r: (r[0], *map(str, r[1:])))
    memory["waits"] = [r for r in memory["waits"] if r[0] >= mark]
    return memory, due


def _remember(state: GroupState, memory: dict, needed: bool) -> None:
    if not needed and not memory["waits"]:
        if state.exists:
            state.remove()
        return
    state.update((json.dumps(memory, default=str),))
    if memory["waits"]:
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, min(r[0] for r in memory["waits"]) + 1))


_MEMORY = T.StructType([T.StructField("memory", T.StringType())])


def judged_runs(runs: DataFrame, by: str = "slot", ts: str = "ts", stale_s: float = 1800, delay: str = "10 minutes") -> DataFrame:
    """ST-4 as a stream: (slot, run_id, accepted, stale) of every run, as ``tasks.overlap_and_stale_runs`` judges them.

    ts is a run's start as a timestamp. A run waits until the watermark has passed its start, as an earlier one could still come; then
    it is judged by the end of the last accepted one. A slot is forgotten once that lies behind the watermark too.
    """
    schema = T.StructType([runs.schema[by], runs.schema["run_id"], T.StructField("accepted", T.BooleanType()), T.StructField("stale", T.BooleanType())])

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, due = _in_time(state, frames, ts, ["start_s", "run_id", "end_s"])
        out = []
        for at, start, run, end in sorted(due, key=lambda r: (r[1], r[2])):
            ok = memory.get("free") is None or start >= memory["free"]
            if ok:
                memory["free"], memory["until"] = end, at + int((end - start) * 1000)
            out.append((key[0], run, ok, ok and end - start > stale_s))
        _remember(state, memory, memory.get("until", 0) >= state.getCurrentWatermarkMs())
        if out:
            yield pd.DataFrame(out, columns=schema.names)

    rows = runs.select(by, "run_id", F.col("start_s").cast("double"), F.col("end_s").cast("double"), ts).withWatermark(ts, delay)
    return rows.groupBy(by).applyInPandasWithState(judge, schema, _MEMORY, "append", GroupStateTimeout.EventTimeTimeout)


def judged_resumes(events: DataFrame, by: str = "task_id", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """ST-3 as a stream: (task, ts, eligible, reason) of every resume, by the events of its task up to then.

    ``events`` are the ledger's rows (kind reserve, claim or finish) and resumes (kind resume with the fingerprint) in one
    stream. A resume waits until the watermark has passed it. What a task's events say is kept for good, as the ledger is.
    """
    schema = T.StructType([events.schema[by], T.StructField("ts", T.TimestampType()), T.StructField("eligible", T.BooleanType()), T.StructField("reason", T.StringType())])

    def reason_of(seen: dict, fingerprint: str | None) -> str | None:
        if seen.get("held") is None:
            return "no reservation"
        if (seen.get("status") or "") != "failed":
            return "not failed"
        if sorted(seen.get("stages", [])) != ["voice_generation"]:
            return "other stages were claimed"
        if "retention ceiling" not in (seen.get("error") or "").lower():
            return "not a duration failure"
        return None if seen["held"] == fingerprint else "request changed"

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, due = _in_time(state, frames, ts, ["kind", "stage", "status", "error", "fingerprint"])
        seen, out = memory.setdefault("seen", {}), []
        for at, kind, stage, status, error, fingerprint in sorted(due, key=lambda r: (r[0], r[1] == "resume")):
            if kind == "reserve" and "held" not in seen:
                seen["held"] = fingerprint
            elif kind == "claim":
                seen["stages"] = sorted({*seen.get("stages", []), *([stage] if stage is not None else [])})
            elif kind == "finish":
                seen["status"], seen["error"] = status, error
            elif kind == "resume":
                reason = reason_of(seen, fingerprint)
                out.append((key[0], pd.Timestamp(at, unit="ms"), reason is None, reason))
        _remember(state, memory, bool(seen))
        if out:
            yield pd.DataFrame(out, columns=schema.names)

    rows = events.select(by, ts, "kind", "stage", "status", "error", "fingerprint").withWatermark(ts, delay)
    return rows.groupBy(by).applyInPandasWithState(judge, schema, _MEMORY, "append", GroupStateTimeout.EventTimeTimeout)


def progress_windows(updates: DataFrame, by: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """ST-5 in tumbling event-time windows with a watermark (an extension): updates by state."""
    n = lambda s: F.count_if(F.col("state") == s)
    return updates.withWatermark("ts", delay).groupBy(F.window("ts", window), by).agg(n(tasks.COMPLETE).alias("completed"), n(tasks.FAILED).alias("failed"), n(tasks.PROCESSING).alias("running"))
