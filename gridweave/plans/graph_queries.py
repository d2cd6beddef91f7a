"""Queries over lineage graphs, statuses and wiring."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import lineage, status, wiring
from gridweave.plans.base import BINDINGS, bound, query, read
from gridweave.shared import checkpoint

UP = "up AS (SELECT DISTINCT job_id, dep_id FROM dag_edges)"
SEEDS = "seeds AS (SELECT job_id FROM dag_nodes WHERE name = 'line')"
LEVELS = "WITH RECURSIVE p(job_id, level) AS (SELECT job_id, 0 FROM dag_nodes WHERE job_id NOT IN (SELECT job_id FROM dag_edges) UNION SELECT e.job_id, level + 1 FROM p JOIN dag_edges e ON e.dep_id = p.job_id), l AS (SELECT job_id, max(level) AS level FROM p GROUP BY job_id)"


def _edges(spark, sf_dir):
    return bound(spark, sf_dir, "dag_edges")


def _seeds(spark, sf_dir):
    return bound(spark, sf_dir, "dag_nodes").filter("name = 'line'").select("job_id")


@query("SELECT DISTINCT job_id, dep_id FROM dag_edges", "dag_edges")
def f1_parents(spark, sf_dir):
    return lineage.parents(_edges(spark, sf_dir))


@query("SELECT DISTINCT dep_id AS job_id, job_id AS child_id FROM dag_edges", "dag_edges")
def f2_children(spark, sf_dir):
    return lineage.children(_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {UP}, {SEEDS}, a(job_id) AS (SELECT job_id FROM seeds UNION SELECT dep_id FROM a JOIN up USING (job_id)) SELECT job_id FROM a", "dag_edges dag_nodes")
def f3_ancestors(spark, sf_dir):
    return lineage.ancestors(_edges(spark, sf_dir), _seeds(spark, sf_dir)).select("job_id")


@query(f"WITH RECURSIVE {UP}, a(job_id) AS (SELECT job_id FROM dag_nodes WHERE name = 'customer' UNION SELECT up.job_id FROM a JOIN up ON up.dep_id = a.job_id) SELECT job_id FROM a", "dag_edges dag_nodes")
def f4_descendants(spark, sf_dir):
    seeds = bound(spark, sf_dir, "dag_nodes").filter("name = 'customer'")
    return lineage.descendants(_edges(spark, sf_dir), seeds).select("job_id")


@query("""WITH used AS (SELECT DISTINCT e.dep_id AS job_id, c.run FROM dag_edges e JOIN dag_nodes c ON c.job_id = e.job_id)
SELECT job_id, run, 'sink' AS kind FROM dag_nodes ANTI JOIN used USING (job_id, run)
UNION ALL SELECT job_id, run, 'root' FROM dag_nodes WHERE job_id NOT IN (SELECT job_id FROM dag_edges)""", "dag_edges dag_nodes")
def f5_sinks_roots(spark, sf_dir):
    nodes, edges = checkpoint(bound(spark, sf_dir, "dag_nodes").select("job_id", "run")), checkpoint(_edges(spark, sf_dir).select("job_id", "dep_id"))
    return lineage.sinks(nodes, edges).withColumn("kind", F.lit("sink")).union(lineage.roots(nodes, edges).withColumn("kind", F.lit("root")))


@query(f"{LEVELS} SELECT job_id, level FROM l", "dag_nodes dag_edges")
def f6_levels(spark, sf_dir):
    done, _, _ = lineage.levels(bound(spark, sf_dir, "dag_nodes"), _edges(spark, sf_dir))
    return done


@query(f"{LEVELS} SELECT job_id, row_number() OVER (ORDER BY level, job_id) - 1 AS ord FROM l", "dag_nodes dag_edges")
def f7_topo_order(spark, sf_dir):
    return lineage.topo_order(bound(spark, sf_dir, "dag_nodes"), _edges(spark, sf_dir)).select("job_id", F.col("ord").cast("long").alias("ord"))


_TREE_SEED = "SELECT min(job_id) FROM dag_nodes WHERE name = 'line'"


@query(f"""WITH RECURSIVE {UP}, t(job_id, path, depth) AS (SELECT s.job_id, [s.job_id], 0 FROM (SELECT min(job_id) AS job_id FROM dag_nodes WHERE name = 'line') s UNION ALL SELECT dep_id, list_append(path, dep_id), depth + 1 FROM t JOIN up USING (job_id)),
m AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY path) > 1 AS seen FROM t)
SELECT row_number() OVER (ORDER BY path) - 1 AS ord, job_id, depth, seen FROM m WHERE NOT EXISTS (SELECT 1 FROM m c WHERE c.seen AND len(c.path) < len(m.path) AND list_slice(m.path, 1, len(c.path)) = c.path)""", "dag_edges dag_nodes")
def f8_dep_tree(spark, sf_dir):
    seed = bound(spark, sf_dir, "dag_nodes").filter("name = 'line'").agg(F.min("job_id")).first()[0]
    return lineage.dep_tree(_edges(spark, sf_dir), seed).withColumn("ord", F.col("ord").cast("long"))


@query("""SELECT job_id, k, v FROM dag_params
UNION ALL SELECT 'c:' || c_custkey, 'name', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 's:' || s_suppkey, 'name', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'o:' || o_orderkey, k, v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey, LATERAL (VALUES ('name', n_name), ('segment', c_mktsegment), ('tag', 'c' || c_custkey)) AS x(k, v)
UNION ALL SELECT 'l:' || l_orderkey || ':' || l_suppkey, k, v FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey,
  LATERAL (VALUES ('name', n_name), ('segment', c_mktsegment), ('prio', o_orderpriority), ('tag', 's' || s_suppkey)) AS x(k, v)""", "dag_params")
def f9_inherit_attributes(spark, sf_dir):
    return lineage.inherit_attributes(bound(spark, sf_dir, "dag_nodes"), _edges(spark, sf_dir), bound(spark, sf_dir, "dag_params"))


@query("SELECT DISTINCT a.name AS src, b.name AS dst, (SELECT count(*) FROM dag_nodes c WHERE c.name = a.name) AS n FROM dag_edges e JOIN dag_nodes a ON a.job_id = e.dep_id JOIN dag_nodes b ON b.job_id = e.job_id WHERE a.name <> b.name", "dag_edges dag_nodes")
def f10_quotient_edges(spark, sf_dir):
    edges, counts = lineage.quotient_edges(_edges(spark, sf_dir), bound(spark, sf_dir, "dag_nodes"))
    return edges.join(counts.withColumnRenamed("name", "src"), "src").select("src", "dst", "n")


@query("SELECT DISTINCT a.name AS src, b.name AS dst, 'hard' AS type FROM dag_edges e JOIN dag_nodes a ON a.job_id = e.dep_id JOIN dag_nodes b ON b.job_id = e.job_id WHERE a.run <> b.run AND a.name <> b.name UNION SELECT * FROM (VALUES ('customer', 'region', 'soft'), ('supplier', 'nation', 'hard')) UNION SELECT * FROM (VALUES ('order', 'nation', 'hard'), ('customer', 'nation', 'hard'))", "dag_edges dag_nodes")
def f11_inter_run_edges(spark, sf_dir):
    nodes = bound(spark, sf_dir, "dag_nodes")
    region = nodes.filter("name = 'region'").select("job_id", F.lit("o").alias("source_run"), F.lit("soft").alias("type"), F.lit("customer").alias("stage"))
    nation = nodes.filter("name = 'nation'").select("job_id", F.explode(F.array(F.lit("o"), F.lit("s"))).alias("source_run"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("stage"))
    return lineage.inter_run_edges(_edges(spark, sf_dir), nodes, region.union(nation))


@query("""SELECT run, string_agg(DISTINCT name, ',' ORDER BY name) AS names, CASE run WHEN 'o' THEN 'sales' WHEN 'l' THEN 'sales' ELSE 'detached' END AS "group" FROM dag_nodes GROUP BY run""", "dag_nodes")
def f12_run_summary(spark, sf_dir):
    return lineage.run_summary(bound(spark, sf_dir, "dag_nodes"), spark.createDataFrame([("sales", "o"), ("sales", "l")], "group string, run string"))


@query("""SELECT name, k, string_agg(DISTINCT v, ',' ORDER BY v) AS vals FROM dag_nodes JOIN dag_params USING (job_id) GROUP BY name, k
HAVING count(DISTINCT v) > 1 OR count(DISTINCT job_id) < (SELECT count(*) FROM dag_nodes d WHERE d.name = dag_nodes.name)""", "dag_nodes dag_params")
def f13_varying_params(spark, sf_dir):
    return lineage.varying_params(bound(spark, sf_dir, "dag_nodes"), bound(spark, sf_dir, "dag_params"))


LOG = "log AS (SELECT job_id, CASE arg_max(s, seq) WHEN 'ok' THEN 'Succeeded' ELSE 'Failed' END AS status FROM completions_fx WHERE job_id IN (SELECT job_id FROM turn_nodes) GROUP BY job_id)"
LIVE = "live AS (SELECT job_id, CASE arg_max(state, seq) WHEN 'Running' THEN 'Running' ELSE 'Queued' END AS status FROM live_fx WHERE job_id IN (SELECT job_id FROM turn_nodes) GROUP BY job_id)"
KNOWN = f"{LOG}, {LIVE}, known AS (SELECT job_id, coalesce(log.status, live.status) AS status FROM log FULL JOIN live USING (job_id))"
DERIVED = f"""{KNOWN}, missing AS (SELECT job_id, string_agg(DISTINCT dep_id, ',' ORDER BY dep_id) AS missing FROM turn_edges WHERE dep_id NOT IN (SELECT job_id FROM known WHERE status = 'Succeeded') GROUP BY job_id),
derived AS (SELECT n.job_id, n.run, coalesce(k.status, CASE WHEN m.missing IS NULL THEN 'Pending' ELSE 'Blocked' END) AS status, CASE WHEN k.status IS NULL THEN m.missing END AS missing FROM turn_nodes n LEFT JOIN known k USING (job_id) LEFT JOIN missing m USING (job_id))"""
ALL = "turn_nodes turn_edges completions_fx live_fx"


def _turns(spark, sf_dir):
    return bound(spark, sf_dir, "turn_nodes"), bound(spark, sf_dir, "turn_edges")


def _log(spark, sf_dir, name="completions_fx"):
    return bound(spark, sf_dir, name).join(_turns(spark, sf_dir)[0].select("job_id"), "job_id", "left_semi")


def _known(spark, sf_dir):
    return status.merge_live(status.latest_outcome(_log(spark, sf_dir)), _log(spark, sf_dir, "live_fx"))


def _derived(spark, sf_dir):
    return status.derive_status(*_turns(spark, sf_dir), _known(spark, sf_dir))


@query(f"WITH {LOG} SELECT job_id, status FROM log", "turn_nodes completions_fx")
def g1_latest_outcome(spark, sf_dir):
    return status.latest_outcome(_log(spark, sf_dir))


@query(f"WITH {KNOWN} SELECT job_id, status FROM known", ALL)
def g2_merge_live(spark, sf_dir):
    return _known(spark, sf_dir)


@query(f"""WITH {LOG}, t AS (SELECT job_id, CASE arg_max(state, (seq % 3) * 1000000000000 + seq) WHEN 'Running' THEN 'Running' ELSE 'Queued' END AS live FROM live_fx WHERE job_id IN (SELECT job_id FROM turn_nodes) GROUP BY job_id)
SELECT job_id, coalesce(status, live) AS status FROM log FULL JOIN t USING (job_id)""", ALL)
def g2_live_targets(spark, sf_dir):
    """Three targets report live states; the third's overwrite the others'."""
    live = _log(spark, sf_dir, "live_fx").withColumn("target", F.col("seq") % 3)
    return status.merge_live(status.latest_outcome(_log(spark, sf_dir)), live)


@query(f"WITH {DERIVED} SELECT job_id, run, status, missing FROM derived", ALL)
def g3_derive_status(spark, sf_dir):
    return _derived(spark, sf_dir).select("job_id", "run", "status", F.array_join("missing_deps", ",").alias("missing"))


@query(f"""WITH {DERIVED} SELECT run, CASE WHEN bool_or(status = 'Running') THEN 'Running' WHEN bool_or(status = 'Failed') THEN 'Failed' WHEN bool_or(status = 'Queued') THEN 'Queued'
WHEN bool_or(status = 'Pending') THEN 'Pending' WHEN bool_or(status = 'Blocked') THEN 'Blocked' ELSE 'Succeeded' END AS status FROM derived GROUP BY run UNION ALL SELECT 'empty', 'Blocked'""", ALL)
def g4_run_status(spark, sf_dir):
    runs = _turns(spark, sf_dir)[0].select("run").distinct().union(spark.sql("SELECT 'empty'"))
    return status.run_status(runs, _derived(spark, sf_dir))


@query(f"WITH {DERIVED} SELECT run, status, count(*) AS n, grouping(run) = 1 AS all_runs, grouping(status) = 1 AS all_states FROM derived GROUP BY CUBE (run, status)", ALL)
def g5_status_counts(spark, sf_dir):
    return status.status_counts(_derived(spark, sf_dir))


@query("""WITH t AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS tick, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY 1)
SELECT strftime(tick, '%Y-%m-%d %H:%M') AS tick, n AS rate FROM t ORDER BY t.tick DESC LIMIT 500""")
def g6_completion_rate(spark, sf_dir):
    out = status.completion_rate(read(spark, sf_dir, "events"), "ts", F.col("event_type") == "purchase", "6 hours")
    return out.select(F.date_format("tick", "yyyy-MM-dd HH:mm").alias("tick"), "rate")


TODO = f"{DERIVED}, seeds AS (SELECT job_id FROM turn_nodes WHERE job_id NOT IN (SELECT dep_id FROM turn_edges)), a(job_id) AS (SELECT job_id FROM seeds UNION SELECT dep_id FROM a JOIN turn_edges USING (job_id)), todo AS (SELECT job_id FROM a WHERE job_id NOT IN (SELECT job_id FROM known WHERE status = 'Succeeded'))"


def _todo(spark, sf_dir):
    nodes, edges = _turns(spark, sf_dir)
    seeds = lineage.sinks(nodes, edges)
    return status.todo(edges, seeds, _known(spark, sf_dir))


@query(f"WITH RECURSIVE {TODO} SELECT job_id FROM todo", ALL)
def g7_todo(spark, sf_dir):
    return _todo(spark, sf_dir)


@query(f"WITH RECURSIVE {TODO} SELECT job_id FROM todo WHERE job_id NOT IN (SELECT job_id FROM turn_edges WHERE dep_id IN (SELECT job_id FROM todo))", ALL)
def g8_ready(spark, sf_dir):
    return status.ready(_todo(spark, sf_dir), bound(spark, sf_dir, "turn_edges"))


@query(f"""WITH RECURSIVE {KNOWN}, d(job_id) AS (SELECT job_id FROM known WHERE status = 'Failed' UNION SELECT e.job_id FROM d JOIN turn_edges e ON e.dep_id = d.job_id)
SELECT job_id, lower(status) AS result FROM known WHERE status IN ('Succeeded', 'Failed') UNION ALL SELECT job_id, 'skipped' FROM d WHERE job_id NOT IN (SELECT job_id FROM known WHERE status IN ('Succeeded', 'Failed'))""", ALL)
def g9_failure_impact(spark, sf_dir):
    return status.failure_impact(*_turns(spark, sf_dir), _known(spark, sf_dir))


@query("WITH u AS (SELECT user_id, event_type, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS us FROM events GROUP BY ALL) SELECT event_type AS phase, count(*) AS units, round(avg(us) / 1e6, 3) AS mean_s FROM u GROUP BY 1")
def g10_phase_durations(spark, sf_dir):
    marks = read(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), F.col("event_type").alias("phase"), "ts")
    return status.phase_durations(marks).select("phase", "units", F.round("mean_s", 3).alias("mean_s"))


@query(f"WITH {LOG} SELECT DISTINCT job_id, state AS target FROM live_fx WHERE job_id IN (SELECT job_id FROM turn_nodes) AND NOT (state = 'Running' AND job_id IN (SELECT job_id FROM log))", ALL)
def g11_prune_tracking(spark, sf_dir):
    tracked = _log(spark, sf_dir, "live_fx").select("job_id", F.col("state").alias("target")).distinct()
    return status.prune_tracking(tracked, status.latest_outcome(_log(spark, sf_dir)), "Running").select("job_id", "target")


@query("SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS tick, count(*) FILTER (event_type = 'purchase') AS rate FROM events GROUP BY 1")
def k3_completion_rate_batch(spark, sf_dir):
    from gridweave.streaming.live import stream_completion_rate

    return stream_completion_rate(read(spark, sf_dir, "events"), "ts", F.col("event_type") == "purchase", "1 day", "2 hours").select(F.date_format("tick", "yyyy-MM-dd").alias("tick"), "rate")


STAGES = "outs AS (SELECT DISTINCT p_brand AS stage, p_type || '/' || (p_size % 7) AS name FROM part WHERE p_size > 48), ins AS (SELECT DISTINCT p_brand AS stage, p_type || '/' || (p_size % 7) AS name FROM part WHERE p_size < 5), deps AS (SELECT DISTINCT a.p_brand AS stage, b.p_brand AS dep FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_brand <> b.p_brand)"


def _declared(spark, sf_dir):
    rows = {n: bound(spark, sf_dir, f"SELECT DISTINCT p_brand AS stage, p_type || '/' || (p_size % 7) AS name FROM part WHERE {w}") for n, w in (("outs", "p_size > 48"), ("ins", "p_size < 5"))}
    rows["deps"] = bound(spark, sf_dir, "SELECT DISTINCT a.stage, b.stage AS dep FROM (SELECT p_partkey AS k, p_brand AS stage FROM part) a JOIN (SELECT p_partkey - 1 AS k, p_brand AS stage FROM part) b ON a.k = b.k WHERE a.stage <> b.stage")
    return rows


@query(f"""WITH {STAGES}, e AS (SELECT DISTINCT stage, dep, name FROM deps JOIN ins USING (stage) JOIN (SELECT stage AS dep, name FROM outs) USING (dep, name))
SELECT stage, dep, name FROM e UNION ALL SELECT stage, dep, NULL FROM deps WHERE (stage, dep) NOT IN (SELECT (stage, dep) FROM e)""")
def d1_wire_implicit(spark, sf_dir):
    d = _declared(spark, sf_dir)
    edges, unmatched = wiring.wire_implicit(d["deps"], d["outs"], d["ins"])
    return edges.union(unmatched.withColumn("name", F.lit(None).cast("string")))


@query(f"WITH {STAGES} SELECT stage, name FROM ins WHERE (stage, name) NOT IN (SELECT (stage, name) FROM deps JOIN ins USING (stage) JOIN (SELECT stage AS dep, name FROM outs) USING (dep, name))")
def d5_check_unresolved(spark, sf_dir):
    d = _declared(spark, sf_dir)
    return wiring.check_unresolved(d["ins"], wiring.wire_implicit(d["deps"], d["outs"], d["ins"])[0])


@query("""SELECT job_id, CAST(pos AS VARCHAR) AS target_input, CASE WHEN dep_id LIKE 's:%' THEN '/store/' || dep_id || '/out/all.csv' ELSE '/store/' || dep_id || '/out/main.csv' END AS path
FROM dag_edges WHERE dep_id NOT LIKE 'r:%' UNION ALL SELECT job_id, dep_id, NULL FROM dag_edges WHERE dep_id LIKE 'r:%'
UNION ALL SELECT job_id, 'store', '/store' FROM dag_nodes WHERE name = 'customer' UNION ALL SELECT job_id, 'meta', '/store/runs/s.json' FROM dag_nodes WHERE name = 'order'""", "dag_edges dag_nodes")
def d9_resolve_inputs(spark, sf_dir):
    nodes = checkpoint(bound(spark, sf_dir, "dag_nodes")).withColumn("stage_type", F.when(F.col("name") == "supplier", "scatter-gather").otherwise("simple"))
    outputs = nodes.filter("name <> 'region'").select("job_id", F.when(F.col("name") == "supplier", "gather").otherwise("main").alias("exe"), F.lit("data").alias("output"), F.when(F.col("name") == "supplier", "$out/all.csv").otherwise("$out/main.csv").alias("template"))
    edges = _edges(spark, sf_dir).select("job_id", "dep_id", F.lit("data").alias("source_output"), F.col("pos").cast("string").alias("target_input"), F.lit("job").alias("mapping_type"), F.lit(None).cast("string").alias("source_run"))
    none, text = F.lit(None).cast("string"), lambda x: F.lit(x)
    store = nodes.filter("name = 'customer'").select("job_id", none, none, text("store"), text("global"), none)
    meta = nodes.filter("name = 'order'").select("job_id", none, none, text("meta"), text("inter-run"), text("s"))
    good, bad = wiring.resolve_inputs(edges.union(store).union(meta), outputs, nodes, "/store")
    return good.union(bad.select("job_id", "dep_id", none))


@query("SELECT job_id, CASE arg_max(s, seq) WHEN 'ok' THEN 'Succeeded' ELSE 'Failed' END AS status FROM completions_fx GROUP BY job_id", "completions_fx")
def k1_stream_latest_batch(spark, sf_dir):
    from gridweave.streaming.live import stream_latest

    return stream_latest(bound(spark, sf_dir, "completions_fx"))


_MAPPED = "m AS (SELECT DISTINCT p_brand AS stage, 'Brand#1' || (p_size % 5 + 1) AS dep, p_type AS source, CASE WHEN p_size > 10 THEN p_type || '/in' END AS target FROM part), o AS (SELECT DISTINCT p_brand AS stage, p_type AS name FROM part WHERE p_size < 30), i AS (SELECT DISTINCT p_brand AS stage, name FROM part, (VALUES (p_type), (p_type || '/in')) AS x(name) WHERE p_size > 20)"


def _mapped(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    m = part.select(F.col("p_brand").alias("stage"), F.concat(F.lit("Brand#1"), (F.col("p_size") % 5 + 1).cast("string")).alias("dep"), F.col("p_type").alias("source"), F.when(F.col("p_size") > 10, F.concat("p_type", F.lit("/in"))).alias("target")).distinct()
    o = part.filter("p_size < 30").select(F.col("p_brand").alias("stage"), F.col("p_type").alias("name")).distinct()
    i = part.filter("p_size > 20").select(F.col("p_brand").alias("stage"), F.explode(F.array("p_type", F.concat("p_type", F.lit("/in")))).alias("name")).distinct()
    return wiring.wire_explicit(m, o, i)


@query(f"""WITH {_MAPPED}, t AS (SELECT stage, dep, source, coalesce(target, source) AS target FROM m), a AS (SELECT *, (dep, source) IN (SELECT (stage, name) FROM o) AS have, (stage, target) IN (SELECT (stage, name) FROM i) AS want FROM t)
SELECT stage, dep, source, target, 'edge' AS what FROM a WHERE have AND want UNION ALL SELECT stage, dep, source, target, 'no such output' FROM a WHERE NOT have UNION ALL SELECT stage, dep, source, target, 'no such input' FROM a WHERE NOT want""")
def d2_wire_explicit(spark, sf_dir):
    good, bad = _mapped(spark, sf_dir)
    return good.withColumn("what", F.lit("edge")).union(bad)


@query(f"WITH {_MAPPED}, t AS (SELECT stage, dep, source, coalesce(target, source) AS target FROM m) SELECT stage, target, count(*) AS n FROM t WHERE (dep, source) IN (SELECT (stage, name) FROM o) AND (stage, target) IN (SELECT (stage, name) FROM i) GROUP BY ALL HAVING count(*) > 1")
def d3_check_disjoint(spark, sf_dir):
    return wiring.check_disjoint(_mapped(spark, sf_dir)[0])


@query("""WITH s AS (SELECT p_type AS stage, bool_or(p_size > 45) AS has FROM part GROUP BY 1), i AS (SELECT DISTINCT p_type AS stage, CASE WHEN p_size < 10 THEN 'run__metadata' WHEN p_size < 20 THEN 'store__base' ELSE 'x' END AS name FROM part), asked AS (SELECT * FROM i WHERE name <> 'x')
SELECT stage, dep_run, name FROM asked JOIN s USING (stage), (SELECT DISTINCT r_name AS dep_run FROM region) WHERE NOT has UNION ALL SELECT stage, NULL, name FROM asked JOIN s USING (stage) WHERE has""")
def d4_wire_inter_run(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumnRenamed("p_type", "stage")
    inputs = part.select("stage", F.when(F.col("p_size") < 10, "run__metadata").when(F.col("p_size") < 20, "store__base").otherwise("x").alias("name")).distinct()
    good, bad = wiring.wire_inter_run(part.select("stage").distinct(), part.filter("p_size > 45").select("stage"), inputs, read(spark, sf_dir, "region").select(F.col("r_name").alias("dep_run")))
    return good.union(bad.select("stage", F.lit(None).cast("string"), "name"))


@query("""WITH i AS (SELECT DISTINCT p_brand AS step, CASE WHEN p_size = 1 THEN 'worker__item' ELSE p_type END AS name FROM part), d AS (SELECT DISTINCT p_brand AS step, 'Brand#1' || (p_size % 5 + 1) AS dep FROM part WHERE p_retailprice > 1000), o AS (SELECT DISTINCT p_brand AS step, p_type AS name FROM part WHERE p_size > 40), x AS (SELECT DISTINCT p_type AS name FROM part WHERE p_size = 50)
SELECT step, name, coalesce((SELECT min(dep) FROM d JOIN o ON o.step = d.dep WHERE d.step = i.step AND o.name = i.name), CASE WHEN name = 'worker__item' THEN 'item' END, CASE WHEN name IN (SELECT name FROM x) THEN 'scatter' END) AS source FROM i""")
def d6_wire_steps(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumnRenamed("p_brand", "step")
    inputs = part.select("step", F.when(F.col("p_size") == 1, "worker__item").otherwise(F.col("p_type")).alias("name")).distinct()
    deps = part.filter("p_retailprice > 1000").select("step", F.concat(F.lit("Brand#1"), (F.col("p_size") % 5 + 1).cast("string")).alias("dep")).distinct()
    outs = part.filter("p_size > 40").select("step", F.col("p_type").alias("name")).distinct()
    return wiring.wire_steps(inputs, deps, outs, part.filter("p_size = 50").select(F.col("p_type").alias("name")))


@query("""WITH e AS (SELECT n_name AS run, r_name AS dep_run, CASE WHEN n_nationkey > 12 THEN 'soft' ELSE 'hard' END AS dep_type FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_name, 'nowhere', 'hard' FROM supplier)
SELECT run, dep_run, dep_type FROM e UNION ALL SELECT 'unknown run', 'nowhere', s_name FROM supplier UNION ALL SELECT 'group named like a run', r_name, NULL FROM region""")
def d8_run_graph(spark, sf_dir):
    nation, region, supplier = (read(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    runs = nation.select(F.col("n_name").alias("run")).union(region.select("r_name")).union(supplier.select("s_name"))
    deps = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("run"), F.col("r_name").alias("dep_run"), F.when(F.col("n_nationkey") > 12, "soft").alias("dep_type"))
    lost = supplier.select("s_name", F.lit("nowhere"), F.lit(None).cast("string"))
    edges, problems = wiring.run_graph(runs, deps.union(lost), region.select(F.col("r_name").alias("group")))
    who = supplier.select(F.lit("nowhere").alias("name"), F.col("s_name").alias("by"))
    return edges.union(problems.distinct().join(who, "name", "left").select("what", "name", "by"))
