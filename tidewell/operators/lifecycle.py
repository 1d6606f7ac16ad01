"""Runs and their seven stages as rows, with pure transitions between states; the driver keeps them in a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import values as V

STALE_SECONDS = 90
ORDER = {s: i for i, s in enumerate(V.STAGES)}


def new_run(spark: SparkSession, run_id: str) -> DataFrame:
    return spark.createDataFrame([(run_id, s, i, "queued", 0, None) for s, i in ORDER.items()], "run_id string, stage string, place int, status string, attempts int, started_epoch long")


def claimable(stages: DataFrame) -> DataFrame:
    """The first stage of each run that has not succeeded, if it is queued."""
    first = stages.where("status not in ('succeeded', 'skipped')").groupBy("run_id").agg(F.min_by(F.struct("stage", "status"), "place").alias("s"))
    return first.select("run_id", "s.stage", "s.status").where("status = 'queued'")


def transition(stages: DataFrame, run_id: str, stage: str, status: str, now: int) -> DataFrame:
    """One stage in a new state; starting it counts an attempt."""
    hit = (F.col("run_id") == run_id) & (F.col("stage") == stage)
    return stages.withColumns({"status": F.when(hit, status).otherwise(F.col("status")), "attempts": F.col("attempts") + F.when(hit & F.lit(status == "running"), 1).otherwise(0), "started_epoch": F.when(hit & F.lit(status == "running"), F.lit(now)).otherwise(F.col("started_epoch")).cast("long")})


def reclaim_stale(stages: DataFrame, now: int, seconds: int = STALE_SECONDS) -> DataFrame:
    stale = (F.col("status") == "running") & (F.col("started_epoch") < now - seconds)
    return stages.withColumn("status", F.when(stale, "queued").otherwise(F.col("status")))


def retry(stages: DataFrame, run_id: str) -> DataFrame:
    """The failed stage of a run and all behind it are queued again."""
    failed = stages.where((F.col("run_id") == run_id) & (F.col("status") == "failed")).agg(F.min("place").alias("_from"))
    return stages.join(failed).withColumn("status", F.when((F.col("run_id") == run_id) & (F.col("place") >= F.col("_from")), "queued").otherwise(F.col("status"))).drop("_from")


def reset(stages: DataFrame, run_id: str) -> DataFrame:
    open_ = (F.col("run_id") == run_id) & F.col("status").isin("queued", "running")
    return stages.withColumn("status", F.when(open_, "skipped").otherwise(F.col("status")))


def progress(stages: DataFrame) -> DataFrame:
    return stages.groupBy("run_id").agg(F.floor(F.count_if(F.col("status") == "succeeded") / F.count("*") * 100 + 0.5).cast("long").alias("percent"))


def expired(items: DataFrame, as_of: int, days: int, at: str = "published_epoch") -> Column:
    return F.col(at) < as_of - days * 86400


def runs_beyond(runs: DataFrame, keep: int) -> DataFrame:
    """Finished runs after the newest ``keep``."""
    newest = runs.orderBy(F.desc("created_epoch"), F.desc("run_id")).limit(keep).select("run_id")
    return runs.join(newest, "run_id", "left_anti")


def kept_events(events: DataFrame, as_of: int, days: int = 180, at: str = "epoch") -> DataFrame:
    """Events of the last days; one without a time stays."""
    return events.where(F.coalesce(~expired(events, as_of, days, at), F.lit(True)))


def purged(scratch: DataFrame, finished: DataFrame) -> DataFrame:
    """Scratch rows of runs that have not finished; rows of no run stay."""
    return scratch.join(finished.select("run_id").distinct(), "run_id", "left_anti")


def table_or_empty(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A table's columns of a schema, null where it lacks one; no rows where there is no such table."""
    empty = spark.createDataFrame([], schema)
    if not spark.catalog.tableExists(name):
        return empty
    there = spark.table(name)
    return there.select(*((F.col(f.name) if f.name in there.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema))


def advance(stages: DataFrame, run_id: str, runners: dict, now: int, metrics: dict | None = None) -> tuple[DataFrame, str | None, dict]:
    """One step of a run: reclaims a stale stage, claims the first that is queued, runs it by name, and records how it ended.

    A runner takes the metrics it left behind and returns (done, metrics); a stage that is not done is queued again and
    finds its metrics next time. Returns the stages, the name of the stage that ran, if any, and all metrics."""
    metrics = dict(metrics or {})
    stages = reclaim_stale(stages, now)
    first = claimable(stages).where(F.col("run_id") == run_id).first()
    if first is None:
        return stages, None, metrics
    name = first["stage"]
    stages = transition(stages, run_id, name, "running", now)
    try:
        done, metrics[name] = runners[name](metrics.get(name, {}))
    except Exception as e:  # noqa: BLE001  a stage's failure is a state of the run
        metrics[name] = {"error": str(e)}
        return transition(stages, run_id, name, "failed", now), name, metrics
    return transition(stages, run_id, name, "succeeded" if done else "queued", now), name, metrics


def advance_until(stages: DataFrame, run_id: str, runners: dict, clock, budget: float = 55.0, metrics: dict | None = None) -> tuple[DataFrame, list[str], dict]:
    """Steps until nothing is to be claimed, a stage has failed, or the budget of seconds is spent."""
    began, ran = clock(), []
    while clock() - began < budget:
        stages, name, metrics = advance(stages, run_id, runners, int(clock()), metrics)
        if name is None:
            break
        ran.append(name)
        stages = stages.sparkSession.createDataFrame(stages.collect(), stages.schema)  # seven rows a run: the plan starts afresh
    return stages, ran, metrics or {}


def run_status(stages: DataFrame) -> DataFrame:
    """(run_id, status): failed, running, queued or succeeded, as its stages are."""
    s = F.col("status")
    return stages.groupBy("run_id").agg(F.when(F.bool_or(s == "failed"), "failed").when(F.every(s.isin("succeeded", "skipped")), F.when(F.bool_or(s == "skipped"), "cancelled").otherwise("succeeded")).when(F.bool_or(s.isin("running", "succeeded")), "running").otherwise("queued").alias("status"))


def start_run(stages: DataFrame, run_id: str) -> tuple[DataFrame, str]:
    """A new run, unless one is queued or running: then that one, the newest by name."""
    active = run_status(stages).where("status in ('queued', 'running')").agg(F.max("run_id")).first()[0]
    if active is not None:
        return stages, active
    return stages.unionByName(new_run(stages.sparkSession, run_id)), run_id


def next_batch(candidates: list, metrics: dict, most: int = 4) -> tuple[list, dict]:
    """Of candidates, frozen in the metrics the first time, the next few that are not processed; and the metrics after them."""
    frozen = metrics.get("candidates") or list(candidates)
    done = metrics.get("processed", [])
    batch = [c for c in frozen if c not in set(done)][:most]
    return batch, {**metrics, "candidates": frozen, "processed": [*done, *batch]}
