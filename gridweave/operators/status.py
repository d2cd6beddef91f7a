"""Outcomes, derived states and what is left to do, from completion logs (seq, job_id, s) and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.operators.lineage import ancestors, descendants, parents


def latest_outcome(log: DataFrame) -> DataFrame:
    """(job_id, status): the last record of each job wins."""
    last = log.groupBy("job_id").agg(F.max_by("s", "seq").alias("s"))
    return last.select("job_id", F.when(F.col("s") == "ok", "Succeeded").otherwise("Failed").alias("status"))


def merge_live(finished: DataFrame, live: DataFrame) -> DataFrame:
    """Finished outcomes beat live states (seq, job_id, state); of live states the latest is Running or else Queued.

    If ``live`` has ``target``, the place of what reported the state, a later target's states overwrite an earlier one's.
    """
    order = F.struct("target", "seq") if "target" in live.columns else F.col("seq")
    now = live.groupBy("job_id").agg(F.max_by("state", order).alias("state"))
    now = now.select("job_id", F.when(F.col("state") == "Running", "Running").otherwise("Queued").alias("live"))
    return finished.join(now, "job_id", "full_outer").select("job_id", F.coalesce("status", "live").alias("status"))


def derive_status(nodes: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """(job_id, status, missing_deps): known, else Pending if every dependency succeeded, else Blocked by those that did not."""
    good = known.filter("status = 'Succeeded'").select(F.col("job_id").alias("dep_id"))
    missing = parents(edges).join(good, "dep_id", "left_anti").groupBy("job_id").agg(F.array_sort(F.collect_set("dep_id")).alias("missing"))
    rows = nodes.join(known, "job_id", "left").join(missing, "job_id", "left")
    status = F.coalesce("status", F.when(F.col("missing").isNull(), "Pending").otherwise("Blocked"))
    return rows.select(*nodes.columns, status.alias("status"), F.when(status == "Blocked", F.col("missing")).alias("missing_deps"))


def run_status(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """(run, status) from jobs (run, status): the most urgent state, Succeeded only if all are; runs without jobs are Blocked."""
    state = F.coalesce("status", F.lit("Blocked"))
    flags = jobs.groupBy("run").agg(*[F.max(state == s).alias(s) for s in ("Running", "Failed", "Queued", "Pending", "Blocked")])
    joined = runs.select("run").join(flags, "run", "left")
    out = F.when(F.col("Blocked").isNull(), "Blocked")
    for s in ("Running", "Failed", "Queued", "Pending", "Blocked"):
        out = out.when(F.col(s), s)
    return joined.select("run", out.otherwise("Succeeded").alias("status"))


def status_counts(jobs: DataFrame) -> DataFrame:
    """(run, status, n, all_runs, all_states) with totals, which the flags tell; submit failures count as failed."""
    jobs = jobs.withColumn("status", F.when(F.col("status") == "SubmitFailed", "Failed").otherwise(F.col("status")))
    cubed = jobs.cube("run", "status").agg(F.count("*").alias("n"), F.grouping("run").alias("a"), F.grouping("status").alias("b"))
    return cubed.select("run", "status", "n", (F.col("a") == 1).alias("all_runs"), (F.col("b") == 1).alias("all_states"))


def completion_rate(events: DataFrame, ts: str, done, width: str, keep: int = 500) -> DataFrame:
    """(tick, rate): completions gained in each time bucket, never below zero; the newest ``keep`` buckets (a report)."""
    ticks = events.groupBy(F.window(ts, width)["start"].alias("tick")).agg(F.count_if(done).alias("n"))
    order = Window.orderBy("tick")  # one row a bucket
    total = ticks.withColumn("total", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rate = F.greatest(F.lit(0), F.col("total") - F.coalesce(F.lag("total").over(order), F.lit(0)))
    return total.withColumn("rate", rate).orderBy(F.desc("tick")).limit(keep).select("tick", "rate")


def todo(edges: DataFrame, seeds: DataFrame, known: DataFrame) -> DataFrame:
    """What the seeds need and has not succeeded; failed jobs are tried again."""
    return ancestors(edges, seeds).select("job_id").join(known.filter("status = 'Succeeded'"), "job_id", "left_anti")


def ready(todo_jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """Jobs to do that wait for none of the others."""
    waits = parents(edges).join(todo_jobs.select(F.col("job_id").alias("dep_id")), "dep_id", "left_semi").select("job_id")
    return todo_jobs.join(waits, "job_id", "left_anti")


def failure_impact(nodes: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """(job_id, result): succeeded, failed, or skipped for what depends on a failure and has not finished; others not listed."""
    failed = known.filter("status = 'Failed'").select("job_id")
    done = known.filter("status in ('Succeeded', 'Failed')").select("job_id", F.lower("status").alias("result"))
    skipped = descendants(edges, failed).select("job_id").join(done.select("job_id"), "job_id", "left_anti")
    return done.union(skipped.select("job_id", F.lit("skipped"))).join(nodes.select("job_id"), "job_id", "left_semi")


def phase_durations(marks: DataFrame) -> DataFrame:
    """(phase, units, mean_s, median_s) from (unit, phase, ts) start and end marks."""
    each = marks.groupBy("unit", "phase").agg((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("us"))
    return each.groupBy("phase").agg(F.count("*").alias("units"), (F.avg("us") / 1e6).alias("mean_s"), (F.percentile_approx("us", 0.5) / 1e6).alias("median_s"))


def prune_tracking(tracked: DataFrame, finished: DataFrame, target: str | None = None) -> DataFrame:
    """Tracked rows (job_id, target) without those that finished, of one target if given."""
    gone = tracked.join(finished.select("job_id"), "job_id", "left_semi")
    if target is not None:
        gone = gone.filter(F.col("target") == target)
    return tracked.join(gone.select("job_id", "target").distinct(), ["job_id", "target"], "left_anti")
