"""Catalogs of runs and jobs: JSON metadata read with explicit schemas (job ids are map keys), and results by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.shared import checkpoint
from gridweave.sources.files import find_files, read_files

_INPUT = "struct<job_id:string,source_output:string,target_input:string,source:string,source_key:string,type:string,dependency_type:string,source_run:string,source_stage_filter:string>"
_HINTS = "struct<mem:string,cpus:int,time:string,partition:string,sbatch_opts:array<string>>"
_EXE = f"struct<path:string,inputs:array<{_INPUT}>,outputs:map<string,string>,deps:array<string>,resource_hints:{_HINTS}>"
_JOB = f"struct<name:string,stage_type:string,params:map<string,string>,executables:map<string,{_EXE}>,resource_hints:{_HINTS}>"
RUN = f"name string, type string, image string, gitHash string, dependencies map<string,string>, jobs map<string,{_JOB}>"
ROOT = "runs array<string>, groups map<string,array<string>>, gitHash string"


@dataclass
class Catalog:
    runs: DataFrame
    run_deps: DataFrame
    run_jobs: DataFrame
    jobs: DataFrame
    executables: DataFrame
    edges: DataFrame
    outputs: DataFrame
    groups: DataFrame | None = None


def _tables(files: DataFrame) -> Catalog:
    """``files``: one row a run file, with ``ord``, its place in load order."""
    run = F.coalesce("name", F.lit("unknown_run"))
    files = files.withColumn("run", run)
    each = files.select("ord", "run", F.explode("jobs").alias("job_id", "job"))
    last = each.groupBy("job_id").agg(F.max_by(F.struct("run", "job"), "ord").alias("r")).select("job_id", "r.*")  # the later run wins
    jobs = last.select("job_id", "run", "job.name", "job.stage_type", "job.params", F.to_json("job.params").alias("params_json"), F.col("job.resource_hints").alias("hints"))
    exes = last.select("job_id", F.explode("job.executables").alias("exe", "e"))
    edges = exes.select("job_id", "exe", F.posexplode("e.inputs").alias("pos", "i")).select("job_id", "exe", "pos", F.col("i.job_id").alias("dep_id"), "i.source_output", "i.target_input", "i.source", "i.source_key", F.col("i.type").alias("mapping_type"), F.col("i.dependency_type").alias("dep_type"), "i.source_run", F.col("i.source_stage_filter").alias("source_stage"))
    return Catalog(
        files.select("run", "image", F.col("gitHash").alias("git_hash")),
        files.select("run", F.explode("dependencies").alias("dep_run", "dep_type")),
        each.select("run", "job_id", "ord"),
        jobs,
        exes.select("job_id", "exe", "e.path", "e.deps", F.col("e.resource_hints").alias("hints")),
        edges,
        exes.select("job_id", "exe", F.explode("e.outputs").alias("output", "template")),
    )


def read_catalog(spark: SparkSession, folder: str, root: str = "root.json", on_missing: str = "skip") -> Catalog:
    """The root file's runs (paths relative to the folder), in order. Missing run files are skipped or, with ``error``, raise.

    The root and a run may each be a folder that holds one file, as Spark writes them. Each listed path is opened as it
    is, by tasks; so files of one name in different folders stay apart. A path listed twice counts where it comes last.
    """
    top = spark.read.schema(ROOT).json(f"{folder}/{root}", multiLine=True)
    listed = top.select(F.posexplode("runs").alias("ord", "run_file")).groupBy("run_file").agg(F.max("ord").alias("ord"))
    found = checkpoint(find_files(listed.withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), "run_file"))))
    if on_missing == "error" and (lost := found.filter("file is null").orderBy("run_file").limit(20).collect()):
        raise FileNotFoundError(f"missing run files: {[r.run_file for r in lost]}")
    files = read_files(found, whole=True).select("ord", F.from_json("value", RUN).alias("r")).select("ord", "r.*")
    out = _tables(checkpoint(files))
    out.groups = top.select(F.explode("groups").alias("group", "r")).select("group", F.explode_outer("r").alias("run"))
    return out


def read_run(spark: SparkSession, path: str) -> Catalog:
    """One run's metadata, whose type must be ``run``."""
    files = spark.read.schema(RUN).json(path, multiLine=True)
    kinds = [r.type for r in files.select("type").collect()]
    if kinds != ["run"]:
        raise ValueError(f"{path} is no run: {kinds}")
    return _tables(files.withColumn("ord", F.lit(0)))


def write_catalog(jobs: DataFrame, path: str, run_deps: DataFrame | None = None) -> None:
    """Jobs by run, one row for each id of a run (the first by name), under ``jobs``; with ``run_deps`` (run, dep_run,
    dep_type) also ``run_deps`` with dep_file, where the jobs of the run depended on are. An unknown one raises."""
    first = F.row_number().over(Window.partitionBy("run", "job_id").orderBy("name"))
    jobs.withColumn("rank", first).filter("rank = 1").drop("rank").write.mode("overwrite").partitionBy("run").parquet(f"{path}/jobs")
    if run_deps is None:
        return
    known = jobs.select(F.col("run").alias("dep_run")).distinct()
    if lost := run_deps.join(known, "dep_run", "left_anti").orderBy("run", "dep_run").limit(20).collect():
        raise ValueError(f"runs that depend on unknown ones: {[(r.run, r.dep_run) for r in lost]}")
    run_deps.select("run", "dep_run", F.coalesce("dep_type", F.lit("hard")).alias("dep_type"), F.concat(F.lit("jobs/run="), "dep_run").alias("dep_file")).write.mode("overwrite").json(f"{path}/run_deps")


def _folders(jobs: DataFrame, base: str | DataFrame) -> DataFrame:
    """(job_id, folder): ``<base>/<job_id>/out``, or what a manifest (job_id, dir) says; a job that it lacks raises."""
    if isinstance(base, str):
        return jobs.select("job_id", F.concat(F.lit(base.rstrip("/") + "/"), "job_id", F.lit("/out")).alias("folder"))
    if lost := jobs.select("job_id").join(base, "job_id", "left_anti").orderBy("job_id").limit(20).collect():
        raise FileNotFoundError(f"no output folder recorded for jobs {[r.job_id for r in lost]}")
    return jobs.select("job_id").join(base.select("job_id", F.rtrim("dir", F.lit("/")).alias("folder")), "job_id")


def output_templates(jobs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """(job_id, template) of the jobs that have the output, in ``gather`` for fan-outs, else in ``main``."""
    exe = F.when(F.col("stage_type") == "scatter-gather", "gather").otherwise("main")
    named = outputs.filter(F.col("output") == key).select("job_id", "exe", F.regexp_replace("template", r"^\$out/", "").alias("template"))
    return jobs.select("job_id", exe.alias("exe")).join(named, ["job_id", "exe"]).select("job_id", "template")


def output_paths(jobs: DataFrame, outputs: DataFrame, key: str, base: str | DataFrame, missing: str = "error") -> DataFrame:
    """(job_id, path) of a named output under ``base``, a folder or a manifest (job_id, dir).

    Jobs without this output raise an error that lists the keys they have or, with ``missing="null"``, have a null path.
    """
    found = output_templates(jobs, outputs, key)
    if missing == "error" and (lost := jobs.select("job_id").join(found, "job_id", "left_anti").orderBy("job_id").first()):
        have = outputs.filter(F.col("job_id") == lost.job_id).select("output").distinct().orderBy("output").limit(100)
        raise KeyError(f"output {key!r} not found in job {lost.job_id!r}; its keys: {[r.output for r in have.collect()]}")
    return _folders(jobs, base).join(found, "job_id", "left").select("job_id", F.concat("folder", F.lit("/"), "template").alias("path"))


def result_files(jobs: DataFrame, outputs: DataFrame, key: str, base: str | DataFrame) -> DataFrame:
    """(job_id, path, file, bytes) of each job's output ``key``; ``file`` and ``bytes`` are null where there is none.

    Each job's own template says where its file is, below ``base``, a folder or a manifest (job_id, dir). For jobs without
    such a key it is taken as a file name. A path may be a folder that holds files.
    """
    ids = jobs.select("job_id").distinct()
    named = ids.join(output_templates(jobs, outputs, key).dropDuplicates(["job_id"]), "job_id", "left")
    path = F.concat("folder", F.lit("/"), F.coalesce("template", F.lit(key)))
    return find_files(named.join(_folders(ids, base), "job_id").select("job_id", path.alias("path")))


def load_results(jobs: DataFrame, outputs: DataFrame, key: str, base: str | DataFrame, eff: DataFrame | None = None, format: str = "csv", schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the same output of all jobs, and the jobs (job_id, path) whose file is missing.

    Rows have job_id, the file's columns and, with ``eff`` (job_id, k, v), the parameter map ``params``. Tasks open the
    files, however many jobs there are, so one job and a million give the same rows and the same missing ones.

    ``format`` is csv with a header line, json (an object a line) or text. csv and json take a ``schema``; csv columns are in
    its order. Without one, each row has ``row``, a map of column names (csv: of the file's own header) to texts, so
    that jobs with different columns need no common schema. A record is a line. Text has ``value``.
    """
    if format not in ("csv", "json", "text"):
        raise ValueError(f"results are csv, json or text, not {format}")
    found = checkpoint(result_files(jobs, outputs, key, base))
    lines = read_files(found).filter(F.trim("value") != "") if format != "text" else read_files(found)
    if format == "csv" and schema:
        parsed = lines.filter("offset > 0").select("job_id", F.from_csv("value", schema).alias("r")).select("job_id", "r.*")
    elif format == "csv":
        lines = checkpoint(lines.select("job_id", "file", "offset", _cells(F.col("value")).alias("cells")))
        heads = lines.filter("offset = 0").select("file", F.col("cells").alias("names"))
        parsed = lines.filter("offset > 0").join(heads, "file").select("job_id", F.map_from_arrays(F.slice("names", 1, F.least(F.size("names"), F.size("cells"))), F.slice("cells", 1, F.least(F.size("names"), F.size("cells")))).alias("row"))
    elif format == "json":
        kind = schema or "map<string,string>"
        parsed = lines.select("job_id", F.from_json("value", kind).alias("row"))
        parsed = parsed.select("job_id", "row.*") if schema else parsed
    else:
        parsed = lines.select("job_id", "value")
    if eff is not None:
        parsed = parsed.join(eff.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("params")), "job_id", "left")
    return parsed, found.filter("file is null").select("job_id", "path")


def _cells(line: Column) -> Column:
    """The cells of a line of CSV: plain ones, and quoted ones with doubled quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), 1)
    return F.transform(raw, lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
