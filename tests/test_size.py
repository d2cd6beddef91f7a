"""What graph operators keep and shuffle."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from gridweave import shared
from gridweave.operators import lineage, lookup, wiring


def test_kept_rows_take_few_bytes(spark):
    shared.shared_dir(spark)
    before = set(Path(shared.shared_dir(spark).removeprefix("file:")).rglob("*"))
    ids = spark.range(100_000).select(F.concat(F.lit("l:"), "id", F.lit(":"), F.col("id") % 1000).alias("job_id"), F.lit("line").alias("name"))
    assert shared.checkpoint(ids).filter("job_id = 'l:7:7'").count() == 1
    made = set(Path(shared.shared_dir(spark).removeprefix("file:")).rglob("*")) - before
    assert 0 < sum(p.stat().st_size for p in made if p.is_file()) < 100_000 * 20  # as rows they took over 50
    assert shared.checkpoint(spark.sql("SELECT 1 AS a, NULL AS b")).collect() == [(1, None)]


def test_repeated_edges_count_once(spark):
    edges = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("e", "self")]
    rows = [(j, d, p) for i in range(3) for p, (j, d) in enumerate(edges)]
    e, n = spark.createDataFrame(rows, "job_id string, dep_id string, pos int"), spark.createDataFrame([(x,) for x in "abcdeabc"], "job_id string")
    done, left, lost = lineage.levels(n, e)
    assert sorted(map(tuple, done.collect())) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)] and left.count() == lost.count() == 0
    assert [tuple(r) for r in lineage.dep_tree(e, "e").orderBy("ord").collect()] == [(0, "e", 0, False), (1, "d", 1, False), (2, "b", 2, False), (3, "a", 3, False), (4, "c", 2, False), (5, "a", 3, True)]
    runs = n.distinct().withColumn("run", F.when(F.col("job_id") < "d", "x").otherwise("y"))
    assert sorted(r.job_id for r in lineage.sinks(runs, e).collect()) == ["b", "c", "e"] and [r.job_id for r in lineage.roots(runs, e).collect()] == ["a"]
    own = spark.createDataFrame([("b", "k", "1"), ("c", "k", "2")], "job_id string, k string, v string")
    assert {r.job_id: r.v for r in lineage.inherit_attributes(n, e, own).collect()} == {"b": "1", "c": "2", "d": "2", "e": "2"}


def test_kept_rows_are_not_broadcast_by_their_size_in_files(spark):
    eff = spark.range(300_000).select(F.concat(F.lit("o:"), "id").alias("job_id"), F.lit("prio").alias("k"), F.lit("1-URGENT").alias("v"))
    jobs = spark.range(400_000).select(F.concat(F.lit("o:"), "id").alias("job_id"), F.lit("order").alias("name"))
    wide = lookup.to_table(jobs, eff, ["prio"])
    assert "BroadcastHashJoin" not in wide._jdf.queryExecution().executedPlan().toString()
    assert tuple(wide.agg(F.count("*"), F.count("prio")).first()) == (400_000, 300_000)


def _shuffled(spark):
    """Bytes of the shuffle files that are there, by name."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    every = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in every if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def _left_by(spark, f, most):
    """What ``f`` gives, and the bytes of its shuffle files that stay; they go a moment after the step."""
    before = _shuffled(spark)
    out = f()
    deadline = time.monotonic() + 20
    while (left := sum(n for k, n in _shuffled(spark).items() if k not in before)) > most and time.monotonic() < deadline:
        time.sleep(0.2)
    return out, left


def test_kept_steps_leave_no_shuffle_files(spark):
    kept, left = _left_by(spark, lambda: shared.checkpoint(spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))), 0)
    assert left == 0 and kept.count() == 1000


def test_graph_operators_leave_few_bytes_in_shuffles(spark):
    lines = spark.range(20_000).select(F.concat(F.lit("l:"), "id").alias("job_id"), F.explode(F.array(F.concat(F.lit("o:"), F.expr("id div 4")), F.concat(F.lit("s:"), F.col("id") % 50))).alias("dep_id"))
    edges = lines.withColumn("pos", F.when(F.col("dep_id").startswith("o"), 0).otherwise(1)).repartition(4)
    nodes = lines.select(F.explode(F.array("job_id", "dep_id")).alias("job_id")).distinct()
    (done, left, _), stays = _left_by(spark, lambda: lineage.levels(nodes, edges), 20_000)
    assert stays < 20_000 and {tuple(r) for r in done.groupBy("level").count().collect()} == {(0, 5050), (1, 20_000)} and left.isEmpty()
    own = edges.select(F.col("dep_id").alias("job_id"), F.substring("dep_id", 1, 1).alias("k"), F.col("dep_id").alias("v")).distinct()
    got, stays = _left_by(spark, lambda: lineage.inherit_attributes(nodes, edges, own), 20_000)
    assert stays < 20_000 and got.count() == 45_050
    outputs = nodes.select("job_id", F.lit("main").alias("exe"), F.lit("data").alias("output"), F.lit("$out/x").alias("template"))
    wired = edges.select("job_id", "dep_id", F.lit("data").alias("source_output"), F.lit("in").alias("target_input"), F.lit("job").alias("mapping_type"), F.lit(None).cast("string").alias("source_run"))

    def resolved():
        good, bad = wiring.resolve_inputs(wired, outputs, nodes.withColumn("stage_type", F.lit("simple")), "/b")
        good.write.format("noop").mode("overwrite").save()
        return good, bad

    (good, bad), stays = _left_by(spark, resolved, 20_000)
    assert stays < 20_000 and good.count() == 40_000 and bad.isEmpty()


def _layers(spark, width=6, depth=4):
    """Each node of a layer depends on three of the layer before and, in pairs, on a chain; some dependencies repeat."""
    edges = [(f"n{d}.{i}", f"n{d - 1}.{(i + j) % width}", j) for d in range(1, depth) for i in range(width) for j in range(3)]
    edges += [("c1", "c0", 0), ("c2", "c1", 0), ("c3", "c2", 0), ("n1.0", "c3", 3), ("n1.0", "c3", 3), ("n2.0", "self", 9)]
    names = sorted({x for j, d, _ in edges for x in (j, d)} - {"self"})
    return spark.createDataFrame([(n,) for n in names], "job_id string"), spark.createDataFrame(edges, "job_id string, dep_id string, pos int")


def _kept_by(spark, f):
    """What ``f`` gives, and the names of what it leaves in the shared folder."""
    folder = Path(shared.shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    return f(), sorted(p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before)


def test_levels_in_slices_are_the_same_and_drop_what_is_done_with(spark, monkeypatch):
    nodes, edges = _layers(spark)
    whole = {r.job_id: r.level for r in lineage.levels(nodes, edges)[0].collect()}
    assert whole["c3"] == 3 and whole["n1.0"] == 4 and whole["n1.1"] == 1 and whole["n3.5"] == 6 and len(whole) == 28
    monkeypatch.setattr(shared, "SLICE_ROWS", 40, raising=False)
    (done, left, lost), names = _kept_by(spark, lambda: lineage.levels(nodes, edges.union(spark.sql("SELECT 'n3.5', 'nowhere', 7")), "ignore"))
    assert {r.job_id: r.level for r in done.collect()} == whole and left.isEmpty() and [tuple(r) for r in lost.collect()] == [("n3.5", "nowhere")]
    assert not {"nodes", "edges", "unknown"} & set(names)


def test_attributes_in_slices_are_the_same(spark, monkeypatch):
    nodes, edges = _layers(spark)
    own = spark.createDataFrame([(f"n0.{i}", k, f"{k}{i}") for i in range(6) for k in "xy"] + [("c0", "z", "0"), ("c2", "x", "c"), ("n1.1", "y", None)], "job_id string, k string, v string")
    whole = sorted(map(tuple, lineage.inherit_attributes(nodes, edges, own).collect()), key=str)
    assert ("n1.0", "x", "c") in whole and ("n1.1", "y", None) in whole and ("n1.2", "x", "x4") in whole
    monkeypatch.setattr(shared, "SLICE_ROWS", 40, raising=False)
    assert sorted(map(tuple, lineage.inherit_attributes(nodes, edges, own).collect()), key=str) == whole


def test_inputs_in_slices_are_resolved_once_and_drop_what_is_done_with(spark, monkeypatch):
    monkeypatch.setattr(shared, "SLICE_ROWS", 10, raising=False)
    jobs = spark.createDataFrame([(f"j{i}", "scatter-gather" if i % 2 else "simple") for i in range(20)], "job_id string, stage_type string")
    outputs = jobs.filter("job_id <> 'j4'").select("job_id", F.explode(F.array(F.lit("main"), F.lit("gather"))).alias("exe"), F.lit("data").alias("output"))
    outputs = outputs.withColumn("template", F.concat(F.lit("$out/"), "exe"))
    rows = [(f"k{i}", f"j{i}", "data", "in", "job", None) for i in range(21)] + [("k0", "j0", "other", "in", "job", None), ("g", None, None, "store", "global", None), ("r", None, None, "meta", "inter-run", "s"), ("n", None, "data", "in", "job", None)]
    edges = spark.createDataFrame(rows, "job_id string, dep_id string, source_output string, target_input string, mapping_type string, source_run string")
    (good, bad), names = _kept_by(spark, lambda: wiring.resolve_inputs(edges, outputs, jobs, "/b"))
    want = [(f"k{i}", "in", f"/b/j{i}/out/{'gather' if i % 2 else 'main'}") for i in range(20) if i != 4]
    assert sorted(map(tuple, good.collect())) == sorted([*want, ("g", "store", "/b"), ("r", "meta", "/b/runs/s.json")])
    assert sorted(map(tuple, bad.collect()), key=str) == sorted([("k4", "j4", "data"), ("k20", "j20", "data"), ("k0", "j0", "other"), ("n", None, "data")], key=str)
    assert "rows" in names and not {"edges", "outputs"} & set(names)
