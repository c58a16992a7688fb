"""Event-sourced queries over an append-only journal (events: task = user_id, status = event_type, sequence = event_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_status(events: DataFrame) -> DataFrame:
    """Each task's latest event (max_by keeps one row per key in partial aggregation, unlike a window)."""
    return events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.max("event_id").alias("sequence"))


def status_counts(events: DataFrame) -> DataFrame:
    return latest_status(events).groupBy("status").agg(F.count(F.lit(1)).alias("n_tasks"))


def next_sequence(events: DataFrame) -> DataFrame:
    return events.agg((F.coalesce(F.max("event_id"), F.lit(0)) + 1).alias("next_sequence"))


def stage_tasks(events: DataFrame, status: str) -> DataFrame:
    """Tasks whose latest event has a status, with their number of events."""
    n = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return latest_status(events).where(F.col("status") == status).join(n, "user_id").select("user_id", "sequence", "n_events")


def sequence_gaps(events: DataFrame) -> DataFrame:
    """Events of a task whose sequence does not exceed the one before it, and the largest step, by task."""
    step = F.col("event_id") - F.lag("event_id").over(W.partitionBy("user_id").orderBy("event_id"))
    return events.select("user_id", step.alias("step")).groupBy("user_id").agg(F.count(F.when(F.col("step") <= 0, 1)).alias("n_unsorted"), F.max("step").alias("largest_step"))


def latest(rows: DataFrame, *key: str, order: str = "sequence") -> DataFrame:
    """The row of greatest sequence of each key, whole; without keys of the table."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), order).alias("row")).where("row IS NOT NULL").select("row.*")


def task_of(definitions: DataFrame, run: str, cache_key: str) -> DataFrame:
    """The task of a run that has a cache key."""
    return latest(definitions.where((F.col("run_id") == run) & (F.col("cache_key") == cache_key)))


def stage_rows(definitions: DataFrame, events: DataFrame, run: str, stage: str) -> DataFrame:
    """Tasks of a stage with their latest event; tasks without events are left out."""
    own = definitions.where((F.col("run_id") == run) & (F.col("stage") == stage)).select("task_id", "stage")
    return own.join(latest(events, "task_id").select("task_id", "status", "sequence"), "task_id")


def latest_plan(runs: DataFrame, plans: DataFrame) -> DataFrame:
    """The latest plan of the run of greatest sequence; none if that run has no plan."""
    return latest(plans.join(latest(runs).select("run_id"), "run_id", "left_semi"))


def verified_output(runs: DataFrame, plans: DataFrame, outputs: DataFrame) -> DataFrame:
    """The latest verified output of the current plan."""
    return latest(outputs.join(latest_plan(runs, plans).select("plan_id"), "plan_id", "left_semi"))


def has_work(runs: DataFrame, *tables: DataFrame) -> DataFrame:
    """(run_id, has_work): whether the current run has a row in any of the tables."""
    any_of = tables[0].select("run_id")
    for t in tables[1:]:
        any_of = any_of.union(t.select("run_id"))
    return latest(runs).select("run_id").join(any_of.distinct().withColumn("w", F.lit(True)), "run_id", "left").select("run_id", F.coalesce("w", F.lit(False)).alias("has_work"))


def append(journal: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """Rows of a journal with new ones after it: their sequence goes on from the greatest, in `order`.

    Ranks come from range partitions and their counts, so no window holds all rows.
    """
    spark = rows.sparkSession
    top = journal.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("n")).first()[0]
    numbered = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("id", F.monotonically_increasing_id())
    numbered = numbered.withColumns({"part": F.shiftright("id", 33), "place": F.col("id").bitwiseAND((1 << 33) - 1)})
    sizes = {r.part: r.n for r in numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, before = [], top
    for p in sorted(sizes):
        start.append((p, before))
        before += sizes[p]
    starts = spark.createDataFrame(start, "part long, before long")
    new = numbered.join(F.broadcast(starts), "part").withColumn("sequence", F.col("before") + F.col("place") + 1)
    return journal.unionByName(new.select(*journal.columns))
