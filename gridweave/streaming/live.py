"""Live views of completion logs; each equals its batch counterpart over the same records."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gridweave import shared
from gridweave.operators.status import latest_outcome
from gridweave.sources.files import exists

#: Where keyed state with values of its own types is kept.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _latest_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last record of each job in every batch of a task, so that a job with many records is no hot key."""
    for batch in batches:
        last: dict[str | None, tuple[int, str]] = {}
        for job, seq, s in zip(*(batch.column(c).to_pylist() for c in ("job_id", "seq", "s")), strict=True):
            if seq is not None and (job not in last or last[job][0] < seq):
                last[job] = (seq, s)
        yield pa.RecordBatch.from_arrays([pa.array(list(last), pa.string()), pa.array([v[0] for v in last.values()], pa.int64()), pa.array([v[1] for v in last.values()], pa.string())], ["job_id", "seq", "s"])


class _LastOutcome(StatefulProcessor):
    """Keeps a job's last record and tells how its outcome changed; what is not later than it changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, s string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        best = (known[0], known[1]) if known else (None, None)
        for frame in rows:
            for seq, s in zip(frame["seq"], frame["s"], strict=True):
                if best[0] is None or seq > best[0]:
                    best = (int(seq), s)
        if best[0] is not None and (not known or best[0] != known[0]):
            self.last.update(best)
            if not known or best[1] != known[1]:
                yield pd.DataFrame({"job_id": [key[0]], "old": [known[1] if known else None], "new": [best[1]]})

    def close(self) -> None:
        pass


def stream_transitions(log: DataFrame) -> DataFrame:
    """(job_id, old, new) whenever a job's last outcome of a stream (seq, job_id, s) changes; old is null at first.

    State is one record a job. Records that come twice, or late, change nothing. Needs the state store that
    ``stateful`` sets for the query's start.
    """
    shared.ship(log.sparkSession)
    last = log.select("job_id", F.col("seq").cast("long").alias("seq"), "s").filter("job_id is not null").mapInArrow(_latest_of, "job_id string, seq long, s string")
    return last.groupBy("job_id").transformWithStateInPandas(_LastOutcome(), "job_id string, old string, new string", "Update", "None")


def stateful(spark: SparkSession, start) -> StreamingQuery:
    """Starts a query (what ``start()`` returns) with the state store that keyed state needs; the session's own stays."""
    before = spark.conf.get(_STORE[0], None)
    spark.conf.set(*_STORE)
    try:
        return start()
    finally:
        if before is None:
            spark.conf.unset(_STORE[0])
        else:
            spark.conf.set(_STORE[0], before)


def stream_latest(log: DataFrame) -> DataFrame:
    """(job_id, status) of a stream (seq, job_id, s), for update or complete mode; state holds one record a job.

    Records that come twice change nothing, as the greatest seq wins.
    """
    return latest_outcome(log)


def stream_run_status(log: DataFrame, jobs: DataFrame, checkpoint: str, table: str, buckets: int = 64, trigger: dict | None = None) -> StreamingQuery:
    """Keeps ``table`` (run, status) current from changes of outcomes alone.

    jobs: (run, job_id). ``stream_transitions`` turns a batch into changes; these are counted by run, and the counters of
    the runs that they touch are moved. Nothing reads outcomes of before. Counters lie in the shared folder in ``buckets``
    parts by hash of the run, a batch writes anew only the parts that it touches, and each counter knows the batch it was
    last moved by, so a batch that is run twice changes nothing. ``table`` is a view of them.
    ``trigger`` is that of ``writeStream.trigger``: by default what is there is read and the query ends.
    """
    spark: SparkSession = log.sparkSession
    counters = f"{shared.shared_dir(spark)}/{table}-counters"
    bucket = F.pmod(F.xxhash64("run"), F.lit(buckets)).cast("int").alias("bucket")
    schema = "run string, jobs long, ok long, fail long, epoch long, bucket int"
    placed = shared.checkpoint(jobs.filter("job_id is not null").select("run", "job_id").distinct())
    totals = shared.checkpoint(placed.groupBy("run").agg(F.count("*").alias("jobs")))

    def view() -> None:
        text = "CASE WHEN fail > 0 THEN 'Failed' WHEN ok < jobs THEN 'Blocked' ELSE 'Succeeded' END"
        spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT run, {text} AS status FROM parquet.`{counters}`")

    def move(batch: DataFrame, epoch: int) -> None:
        fresh = shared.checkpoint(batch)
        step = lambda s: (F.sum((F.col("new") == s).cast("long")) - F.sum(F.coalesce((F.col("old") == s).cast("long"), F.lit(0)))).alias(s)
        moved = shared.checkpoint(placed.join(shared.small(fresh), "job_id").groupBy("run").agg(step("ok"), step("fail")).join(totals, "run").select("run", "jobs", "ok", "fail", F.lit(epoch).cast("long").alias("epoch"), bucket))
        parts = [r.bucket for r in moved.select("bucket").distinct().collect()]  # at most ``buckets``
        if not parts:
            return
        old = spark.read.schema(schema).parquet(counters).filter(F.col("bucket").isin(parts)) if exists(spark, counters) else spark.createDataFrame([], schema)
        pair = old.select("run", F.struct("jobs", "ok", "fail", "epoch").alias("o")).join(moved.select("run", F.struct("jobs", "ok", "fail", "epoch").alias("m")), "run", "full_outer")
        stays = F.coalesce((F.col("o.epoch") >= epoch) | F.col("m").isNull(), F.lit(False))
        now = F.when(stays, F.col("o")).otherwise(F.struct(F.col("m.jobs").alias("jobs"), *((F.coalesce(F.col(f"o.{c}"), F.lit(0)) + F.col(f"m.{c}")).alias(c) for c in ("ok", "fail")), F.col("m.epoch").alias("epoch")))
        rows = shared.checkpoint(pair.select("run", now.alias("n")).select("run", "n.*", bucket))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(counters)
        view()

    changes = stream_transitions(log)
    return stateful(spark, lambda: changes.writeStream.outputMode("update").foreachBatch(move).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def stream_completion_rate(events: DataFrame, ts: str, done: Column, width: str, late: str) -> DataFrame:
    """(tick, rate): completions in each time bucket, for append mode; events later than ``late`` behind are not counted."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(F.count_if(done).alias("rate"))
    return counted.select(F.col("w.start").alias("tick"), "rate")
