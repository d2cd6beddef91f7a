"""Completion logs: JSON lines {"id", "s"} and marker files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.shared import small
from gridweave.sources.files import create_new, exists, list_folders, read_text, write_text

RECORD = "id string, s string, at long"


def parsed_records(line: Column) -> Column:
    return F.from_json(line, RECORD)


def split_records(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Good records (job_id, s, ...) and lines that are none (blank ones are neither)."""
    read = lines.withColumn("__r", parsed_records(F.col(line)))
    good = F.coalesce(F.col("__r.id").isNotNull() & F.col("__r.s").isin("ok", "fail"), F.lit(False))
    others = [c for c in lines.columns if c != line]
    return read.filter(good).select(*others, F.col("__r.id").alias("job_id"), F.col("__r.s").alias("s")), read.filter(~good & (F.trim(line) != "")).select(lines.columns)


def read_completions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(seq, job_id, s) and broken lines of a log, a file or a folder; None where there is no log, which is not an empty log.

    seq orders records. What ``append_completions`` has written comes in the order of its commits; folders without a
    commit are appends that did not end and are passed over. Files of others in the folder come before, by the time that
    their records tell as ``at`` or else by the file's own. Then by file, by the split of the file, by the row in the split.
    """
    if not exists(spark, path):
        return None
    place = {"file": F.col("_metadata.file_path"), "start": F.col("_metadata.file_block_start"), "row": F.monotonically_increasing_id()}
    order = lambda n, at: F.struct(n.alias("commit"), at.alias("at"), *(c.alias(k) for k, c in place.items())).alias("seq")
    time = F.coalesce(parsed_records(F.col("value"))["at"], F.unix_micros("_metadata.file_modification_time"))
    lines = spark.read.text(path).select("value", order(F.lit(-1).cast("long"), time))
    commits = f"{path.rstrip('/')}/commits"
    if exists(spark, commits):
        done = spark.read.text(f"{commits}/*").select(F.col("value").alias("folder"), F.regexp_extract("_metadata.file_path", "([0-9]+)$", 1).cast("long").alias("n"))
        data = spark.read.text(f"{path.rstrip('/')}/data-*").select("value", F.regexp_extract("_metadata.file_path", "/(data-[0-9a-f]+)/[^/]+$", 1).alias("folder"), order(F.lit(0).cast("long"), F.lit(0).cast("long")))
        lines = lines.union(data.join(small(done), "folder").select("value", F.col("seq").withField("commit", F.col("n")).alias("seq")))
    return split_records(lines)


def append_completions(df: DataFrame, path: str) -> int:
    """Appends one JSON line for each (job_id, s) to a log, and gives the append's place in it.

    The lines are written to a folder of their own; then the next number's commit file, which names the folder, is made
    if it is not there, and if another writer has made it, the one after. So commits are in one order whoever writes, an
    append costs the same whatever the log holds, and one that fails leaves nothing that is read. Records of one append
    that concern one job should be one record, as nothing orders them.
    """
    spark, base = df.sparkSession, path.rstrip("/")
    folder = f"data-{uuid.uuid4().hex}"
    df.select(F.col("job_id").alias("id"), "s").write.json(f"{base}/{folder}")
    n = int(read_text(spark, f"{base}/_last") or 0) + 1  # where to begin; it may be behind
    while not create_new(spark, f"{base}/commits/{n:020d}", folder):
        n += 1
    write_text(spark, f"{base}/_last", str(n))
    return n


def scan_markers(spark: SparkSession, outputs: str) -> DataFrame:
    """(job_id, status) from ``<job>/<folder>/SUCCESS`` and ``FAIL`` files; with both, success wins.

    Markers are empty files, which Spark's scans leave out; tasks list the folders, level by level.
    """
    within = F.concat("folder", F.lit("/"), "name").alias("folder")
    jobs = list_folders(spark.createDataFrame([(outputs.rstrip("/"),)], "folder string")).filter("is_folder").select(within)
    found = list_folders(list_folders(jobs).filter("is_folder").select(within)).filter("name in ('SUCCESS', 'FAIL')")
    parts = found.select(F.regexp_extract("folder", "([^/]+)/[^/]+$", 1).alias("job_id"), (F.col("name") == "SUCCESS").alias("ok"))
    return parts.groupBy("job_id").agg(F.when(F.max("ok"), "Succeeded").otherwise("Failed").alias("status"))
