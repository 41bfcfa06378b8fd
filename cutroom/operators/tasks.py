"""Task state, once-only ledgers and overlapping runs, as batch operators over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: States of a task.
FAILED, COMPLETE, PROCESSING = -1, 1, 4


def latest_task_state(updates: DataFrame, by: str = "task_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """ST-1. The last update replaces a task's whole record; progress is whole and at most 100, a missing state is processing."""
    last = updates.groupBy(by).agg(F.max(F.struct(*order, "state", "progress")).alias("l"))
    return last.select(by, F.coalesce("l.state", F.lit(PROCESSING)).alias("state"), F.least(F.lit(100), F.floor(F.coalesce("l.progress", F.lit(0.0))).cast("int")).alias("progress"))


def claim_once_ledger(claims: DataFrame, by: str = "task_id", stage: str = "stage", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """ST-2. Every claim with whether it was the first of its task and stage.

    The first claim is a partially aggregated minimum that is joined back: a stage that is claimed very often is no single task's work.
    """
    first = claims.groupBy(by, stage).agg(F.min(F.struct(*order)).alias("__first"))
    rows = claims.join(first, [by, stage]).withColumn("accepted", F.struct(*order).eqNullSafe(F.col("__first")))
    return rows.drop("__first").withColumn("reason", F.when(~F.col("accepted"), "stage already claimed"))


def resume_eligibility(ledger: DataFrame, resumes: DataFrame, by: str = "task_id") -> DataFrame:
    """ST-3. Whether a task may resume, and why not. ledger: (by, ts, kind, stage, status, error, fingerprint)."""
    last = ledger.where("kind = 'finish'").groupBy(by).agg(F.max_by(F.struct("status", "error"), "ts").alias("f"))
    held = ledger.where("kind = 'reserve'").groupBy(by).agg(F.min_by("fingerprint", "ts").alias("held"))
    stages = ledger.where("kind = 'claim'").groupBy(by).agg(F.sort_array(F.collect_set("stage")).alias("stages"))
    rows = resumes.join(held, by, "left").join(last, by, "left").join(stages, by, "left")
    reason = (
        F.when(F.col("held").isNull(), "no reservation").when(F.coalesce(F.col("f.status"), F.lit("")) != "failed", "not failed")
        .when(~F.coalesce(F.col("stages") == F.array(F.lit("voice_generation")), F.lit(False)), "other stages were claimed")
        .when(~F.lower(F.coalesce("f.error", F.lit(""))).contains("retention ceiling"), "not a duration failure").when(F.col("held") != F.col("fingerprint"), "request changed")
    )
    return rows.select(by, reason.isNull().alias("eligible"), reason.alias("reason"))


def overlap_and_stale_runs(runs: DataFrame, by: str, stale_s: float = 1800) -> DataFrame:
    """ST-4. Runs that begin while an accepted one holds the slot are rejected; long holds are stale.

    Where a run begins no earlier than the end of every run before it, the slot is free whoever was accepted: a new island
    of runs starts there, and the fold is over one island, not over a slot's whole history.
    """
    w = Window.partitionBy(by).orderBy("start_s", "run_id")
    ends = F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = runs.select(by, "run_id", "start_s", "end_s").withColumn("__new", F.coalesce((F.col("start_s") >= ends).cast("bigint"), F.lit(1)))
    islands = rows.withColumn("__island", F.sum("__new").over(w)).groupBy(by, "__island").agg(F.sort_array(F.collect_list(F.struct("start_s", "run_id", "end_s"))).alias("__runs"))

    def judge(acc: Column, x: Column) -> Column:
        ok = acc["free"].isNull() | (x["start_s"] >= acc["free"])
        row = F.struct(x["run_id"].alias("run_id"), ok.alias("accepted"), (ok & (x["end_s"] - x["start_s"] > stale_s)).alias("stale"))
        return F.struct(F.when(ok, x["end_s"]).otherwise(acc["free"]).alias("free"), F.concat(acc["judged"], F.array(row)).alias("judged"))

    kind = T.ArrayType(T.StructType([T.StructField("run_id", runs.schema["run_id"].dataType), T.StructField("accepted", T.BooleanType()), T.StructField("stale", T.BooleanType())]))
    start = F.struct(F.lit(None).cast("double").alias("free"), F.array().cast(kind).alias("judged"))
    judged = F.explode(F.aggregate("__runs", start, judge, lambda acc: acc["judged"]))
    return islands.select(by, judged.alias("__j")).select(by, "__j.run_id", "__j.accepted", "__j.stale")


def task_progress_rollup(updates: DataFrame, by: str, task: str = "task_id") -> DataFrame:
    """ST-5. Completed, failed and running tasks of each job and its mean progress, from the tasks' latest states."""
    jobs = updates.select(task, by).distinct()
    state = latest_task_state(updates, task).join(jobs, task)
    n = lambda s: F.count_if(F.col("state") == s)
    return state.groupBy(by).agg(n(COMPLETE).alias("completed"), n(FAILED).alias("failed"), n(PROCESSING).alias("running"), F.round(F.avg("progress"), 3).alias("progress"))


def task_page(tasks: DataFrame, page: int, page_size: int, order: list[str], root: str = "/tasks/", uri: str = "http://localhost/tasks/") -> DataFrame:
    """T-8. One page in insertion order with the total; local paths become public addresses."""
    total = tasks.agg(F.count("*").alias("total"))
    rows = tasks.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    rows = rows.withColumn("path", F.when(F.col("path").startswith(root), F.concat(F.lit(uri), F.expr(f"substr(path, {len(root) + 1})"))).otherwise(F.col("path")))
    return rows.join(F.broadcast(total))  # the total is one row


def typed_from_text(df: DataFrame, text: str = "value") -> DataFrame:
    """X-17. A stored text as whole number, list of texts, or text, whichever it reads as."""
    t = F.trim(F.col(text))
    listed = F.when(t.startswith("["), F.from_json(F.replace(t, F.lit("'"), F.lit('"')), "array<string>"))
    return df.withColumns({"as_int": F.expr(f"try_cast(trim({text}) as bigint)"), "as_list": listed, "kind": F.when(F.expr(f"try_cast(trim({text}) as bigint)").isNotNull(), "int").when(listed.isNotNull(), "list").otherwise("text")})
