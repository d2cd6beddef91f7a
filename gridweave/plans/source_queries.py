"""Queries over files that Spark writes from the tables into the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import status
from gridweave.plans.base import bound, query, read
from gridweave.plans.graph_queries import ALL, DERIVED
from gridweave.shared import shared_path
from gridweave.sources import catalog, completions, files

_HINTS = "named_struct('mem', {mem}, 'cpus', {cpus}, 'time', cast(null as string), 'partition', cast(null as string), 'sbatch_opts', cast(null as array<string>))"
_INPUTS = "array(named_struct('job_id', {dep}, 'source_output', 'data', 'target_input', 'parent', 'type', 'job'))"


def _jobs(spark, sf_dir):
    """(run, job_id, job): a run for each nation, with the nation's job and one for each of its customers."""
    job = "named_struct('name', {name}, 'stage_type', 'simple', 'params', map({params}), 'executables', map('main', named_struct('path', 'x', 'inputs', {inputs}, 'outputs', map('data', '$out/d.csv'))), 'resource_hints', {hints}) AS job"
    none = "cast(array() as array<struct<job_id:string,source_output:string,target_input:string,type:string>>)"
    nation = bound(spark, sf_dir, f"SELECT 'run' || n_nationkey AS run, 'n:' || n_nationkey AS job_id, {job.format(name=chr(39) + 'nation' + chr(39), params=chr(39) + 'title' + chr(39) + ', n_name', inputs=none, hints='cast(null as struct<mem:string,cpus:int,time:string,partition:string,sbatch_opts:array<string>>)')} FROM nation")
    dep = "'n:' || c_nationkey"
    customer = bound(spark, sf_dir, f"SELECT 'run' || c_nationkey AS run, 'c:' || c_custkey AS job_id, {job.format(name=chr(39) + 'customer' + chr(39), params=chr(39) + 'segment' + chr(39) + ', c_mktsegment', inputs=_INPUTS.format(dep=dep), hints=_HINTS.format(mem='c_nationkey || chr(71)', cpus='c_nationkey'))} FROM customer")
    return nation.union(customer)


def _write_catalog(spark, sf_dir):
    """A root and a run file for each run under a new folder."""
    folder = shared_path(spark, "catalog")
    body = F.to_json(F.struct(F.col("run").alias("name"), F.lit("run").alias("type"), F.lit("img").alias("image"), F.map_from_entries(F.collect_list(F.struct("job_id", "job"))).alias("jobs")))
    _jobs(spark, sf_dir).groupBy("run").agg(body.alias("value")).repartition("run").write.partitionBy("run").text(f"{folder}/runs")
    names = _jobs(spark, sf_dir).select("run").distinct()
    root = names.agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list("run")), lambda r: F.concat(F.lit("runs/run="), r)).alias("runs"), F.create_map(F.lit("all"), F.array_sort(F.collect_list("run"))).alias("groups"))).alias("value"))
    root.coalesce(1).write.text(f"{folder}/root")
    return folder


_CATALOG = "SELECT 'n:' || n_nationkey AS job_id, 'run' || n_nationkey AS run, 'nation' AS name, n_name AS param, NULL::VARCHAR AS mem, 0 AS cpus, 0::BIGINT AS inputs FROM nation UNION ALL SELECT 'c:' || c_custkey, 'run' || c_nationkey, 'customer', c_mktsegment, c_nationkey || 'G', c_nationkey, 1 FROM customer"


def _flat(c):
    inputs = c.edges.groupBy("job_id").agg(F.count("*").alias("inputs"))
    return c.jobs.join(inputs, "job_id", "left").select("job_id", "run", "name", F.coalesce(F.col("params")["title"], F.col("params")["segment"]).alias("param"), "hints.mem", F.coalesce("hints.cpus", F.lit(0)).alias("cpus"), F.coalesce("inputs", F.lit(0)).alias("inputs"))


@query(_CATALOG)
def a1_read_catalog(spark, sf_dir):
    return _flat(catalog.read_catalog(spark, _write_catalog(spark, sf_dir), "root", "error"))


@query(f"SELECT * FROM ({_CATALOG}) WHERE run = 'run0'")
def a2_read_run(spark, sf_dir):
    """One run's file, as the operator reads it."""
    return _flat(catalog.read_run(spark, f"{_write_catalog(spark, sf_dir)}/runs/run=run0"))


@query("SELECT 'run' || n_nationkey AS run, count(c_custkey) + 1 AS jobs, 'jobs/run=run' || n_regionkey AS dep_file FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey")
def a3_write_catalog(spark, sf_dir):
    path, rows = shared_path(spark, "written"), _jobs(spark, sf_dir).select("run", "job_id", "job.name")
    deps = bound(spark, sf_dir, "SELECT 'run' || n_nationkey AS run, 'run' || n_regionkey AS dep_run, cast(null as string) AS dep_type FROM nation")
    catalog.write_catalog(rows.union(rows), path, deps)
    counts = spark.read.parquet(f"{path}/jobs").groupBy("run").agg(F.count("*").alias("jobs"))
    return counts.join(spark.read.schema("run string, dep_run string, dep_type string, dep_file string").json(f"{path}/run_deps"), "run").select("run", "jobs", "dep_file")


@query("SELECT 'run=run' || n_nationkey AS name, 'directory' AS kind FROM nation WHERE n_nationkey >= 10")
def a4_scan_paths(spark, sf_dir):
    found = files.scan_paths(spark, f"{_write_catalog(spark, sf_dir)}/runs", "directory", r"run=run\d\d")
    return found.select(F.substring_index("path", "/", -1).alias("name"), "kind")


@query("SELECT job_id, CASE WHEN name = 'supplier' THEN '/base/' || job_id || '/out/all.csv' WHEN name <> 'region' THEN '/base/' || job_id || '/out/main.csv' END AS path FROM dag_nodes", "dag_nodes")
def a5_output_paths(spark, sf_dir):
    nodes = bound(spark, sf_dir, "dag_nodes").withColumn("stage_type", F.when(F.col("name") == "supplier", "scatter-gather").otherwise("simple"))
    made = nodes.filter("name <> 'region'").select("job_id", F.explode(F.array(F.lit("main"), F.lit("gather"))).alias("exe"), F.lit("data").alias("output"), "name")
    made = made.select("job_id", "exe", "output", F.when(F.col("exe") == "gather", "$out/all.csv").otherwise("$out/main.csv").alias("template"))
    return catalog.output_paths(nodes, made, "data", "/base", missing="null")


def _results(spark, sf_dir):
    """A job for each region, whose output is the customers of its nations; even regions name it ``data``, odd ones not."""
    base, rows = shared_path(spark, "results"), bound(spark, sf_dir, "SELECT c_custkey, c_acctbal, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
    regions = read(spark, sf_dir, "region").select(F.concat(F.lit("r:"), "r_regionkey").alias("job_id"), "r_regionkey", "r_name", F.lit("simple").alias("stage_type"))
    for r in regions.collect():  # the five regions
        rows.filter(F.col("n_regionkey") == r.r_regionkey).drop("n_regionkey").coalesce(1).write.csv(f"{base}/{r.job_id}/out/{'d' if r.r_regionkey % 2 else 'e'}.csv", header=True)
    outputs = regions.select("job_id", F.lit("main").alias("exe"), F.lit("data").alias("output"), F.when(F.col("r_regionkey") % 2 == 1, "$out/d.csv").otherwise("$out/e.csv").alias("template"))
    return base, regions, outputs


@query("SELECT 'c:' || c_custkey AS job_id, o_orderkey, o_totalprice, c_mktsegment AS segment, o_orderkey IS NULL AS missing FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND c_custkey % 10 > 0")
def a6_load_results(spark, sf_dir):
    """A job for each customer, whose result is its orders; one in ten has not written its file."""
    base = shared_path(spark, "results")
    place = lambda key: F.concat(F.lit(f"{base}/"), F.lpad(F.hex(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(256))), 2, "0"), F.lit("/c%3A"), key)  # noqa: E731  # no folder of all jobs
    orders = read(spark, sf_dir, "orders").filter("o_custkey % 10 > 0").select(F.concat(place("o_custkey"), F.lit("/d.csv")).alias("path"), F.to_csv(F.struct("o_orderkey", "o_totalprice")).alias("line"))
    files.write_files(orders, "path", "line", "o_orderkey,o_totalprice")
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("c:"), "c_custkey").alias("job_id"), F.lit("simple").alias("stage_type"), "c_mktsegment")
    jobs, at = customers.drop("c_custkey"), customers.select("job_id", place("c_custkey").alias("dir"))
    outputs = jobs.select("job_id", F.lit("main").alias("exe"), F.lit("data").alias("output"), F.lit("$out/d.csv").alias("template"))
    eff = jobs.select("job_id", F.lit("segment").alias("k"), F.col("c_mktsegment").alias("v"))
    got, missing = catalog.load_results(jobs, outputs, "data", at, eff, schema="o_orderkey long, o_totalprice double")
    none = jobs.join(missing, "job_id").select("job_id", F.lit(None).cast("long").alias("o_orderkey"), F.lit(None).cast("double").alias("o_totalprice"), F.col("c_mktsegment").alias("segment"), F.lit(True).alias("missing"))
    return got.select("job_id", "o_orderkey", "o_totalprice", F.col("params")["segment"].alias("segment"), F.lit(False).alias("missing")).union(none)


@query("SELECT 'r:' || r_regionkey AS job_id, 'executed' AS state, CASE WHEN r_regionkey % 2 = 1 THEN 'd.csv' ELSE 'e.csv' END AS name FROM region UNION ALL SELECT 'n:' || n_nationkey, 'not executed', NULL FROM nation")
def a11_list_outputs(spark, sf_dir):
    base, jobs, _ = _results(spark, sf_dir)
    every = jobs.select("job_id").union(bound(spark, sf_dir, "SELECT 'n:' || n_nationkey FROM nation"))
    found = files.list_outputs(spark, every, base)
    return found.select("job_id", "state", F.regexp_extract("file", "^out/([^/]+)/", 1).alias("name")).distinct().withColumn("name", F.when(F.col("name") != "", F.col("name")))


@query("SELECT 's' || s_suppkey AS job_id, CASE WHEN s_acctbal > 0 THEN 'Succeeded' ELSE 'Failed' END AS status FROM supplier")
def a8_scan_markers(spark, sf_dir):
    """Markers are empty files, which tasks write: one or two for each supplier."""
    base = shared_path(spark, "markers")
    names = F.when(F.col("s_acctbal") > 0, F.array(F.lit("FAIL"), F.lit("SUCCESS"))).otherwise(F.array(F.lit("FAIL")))
    marks = read(spark, sf_dir, "supplier").select("s_suppkey", F.explode(names).alias("name"))
    files.write_files(marks.select(F.concat(F.lit(f"{base}/s"), "s_suppkey", F.lit("/marks/"), "name").alias("path"), F.lit(None).cast("string").alias("value")), "path", "value")
    return completions.scan_markers(spark, base)


@query("SELECT job_id, CASE WHEN bool_or(s = 'ok') THEN 'Succeeded' ELSE 'Failed' END AS status FROM completions_fx GROUP BY job_id", "completions_fx")
def a9_append_completions(spark, sf_dir):
    """Failures are appended first, then successes; the later append wins."""
    path, rows = shared_path(spark, "log"), bound(spark, sf_dir, "completions_fx").select("job_id", "s").distinct()
    for s in ("fail", "ok"):
        completions.append_completions(rows.filter(F.col("s") == s), path)
    return status.latest_outcome(completions.read_completions(spark, path)[0])


@query(f"""WITH {DERIVED}, log_only AS (SELECT n.run, l.status FROM turn_nodes n LEFT JOIN log l USING (job_id)) SELECT run, CASE WHEN bool_or(status = 'Failed') THEN 'Failed' WHEN bool_or(status IS NULL) THEN 'Blocked' ELSE 'Succeeded' END AS status FROM log_only WHERE run IN (SELECT run FROM turn_nodes SEMI JOIN log USING (job_id)) GROUP BY run""", ALL)
def k2_stream_run_status(spark, sf_dir):
    from gridweave.streaming.live import stream_run_status

    path, name = shared_path(spark, "stream"), shared_path(spark, "live").rsplit("/", 1)[1].replace("-", "_")
    rows = bound(spark, sf_dir, "completions_fx")
    rows.repartitionByRange(4, "seq").write.json(path)
    log = spark.readStream.schema("seq long, job_id string, s string").option("maxFilesPerTrigger", 2).json(path)
    stream_run_status(log, bound(spark, sf_dir, "turn_nodes").select("run", "job_id"), shared_path(spark, "stream-checkpoint"), name).awaitTermination()
    return spark.table(name)
