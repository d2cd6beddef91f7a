"""Queries over collections: filters, lookups, flat views, logs and tails."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from gridweave.functions.ids import get_path
from gridweave.operators import lineage, lookup
from gridweave.plans.base import bound, query, read
from gridweave.plans.graph_queries import ALL, DERIVED, _derived
from gridweave.shared import checkpoint
from gridweave.sources.completions import split_records
from gridweave.sources.files import tail_lines


def _parts(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit("-"), "p_name").alias("job_id"), F.col("p_type").alias("name"), F.col("p_brand").alias("run"), F.col("p_size").alias("size"), F.col("p_name").alias("title"), F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type")).alias("eff"))


PARTS = "parts AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '-' || p_name AS job_id, p_type AS name, p_brand AS run, p_size AS size FROM part)"


@query("SELECT seq, job_id, s FROM completions_fx", "completions_fx")
def a7_read_completions(spark, sf_dir):
    lines = bound(spark, sf_dir, "completions_fx").select("seq", F.to_json(F.struct(F.col("job_id").alias("id"), "s")).alias("value"))
    broken = read(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("event_id").alias("seq"), F.concat(F.lit('{"id": "x", '), "props").alias("value"))
    good, _ = split_records(lines.union(broken).union(broken.withColumn("value", F.lit(" "))))
    return good.select("seq", "job_id", "s")


@query("""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents WHERE text <> '')
SELECT doc_id, (p - greatest(len(ls) - 3, 0))::INT - 1 AS pos, list_extract(ls, p) AS line FROM l, unnest(range(greatest(len(ls) - 3, 0) + 1, len(ls) + 1)) AS r(p)""".replace("\\\\n", "\\n"))
def a10_tail_lines(spark, sf_dir):
    return tail_lines(read(spark, sf_dir, "documents"), 3, "doc_id", "text")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#13' AND p_size = 10 UNION ALL SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' AND p_size > 40")
def e1_e4_where(spark, sf_dir):
    rows = _parts(spark, sf_dir)
    none = lookup.where(rows, no_such_column=1)
    return lookup.where(rows, run="Brand#13", size=10).union(lookup.where(rows, lambda d: d["size"] > 40, run="Brand#12")).union(none).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE starts_with(p_type, 'S') AND contains(p_name, 'a') AND ends_with(CAST(p_size AS VARCHAR), '5')")
def e2_where_text(spark, sf_dir):
    return lookup.where(_parts(spark, sf_dir), name__startswith="S", size__endswith="5", title__contains="a").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size = 7 AND contains(p_type, 'O')")
def e5_where_params(spark, sf_dir):
    return lookup.where(_parts(spark, sf_dir), param_size="7", param_type__contains="O").select("p_partkey")


@query(f"WITH {PARTS} SELECT p_partkey, 'text' AS kind FROM parts WHERE contains(lower(job_id), 'promo') OR contains(lower(name), 'promo') OR contains(lower(run), 'promo') UNION ALL SELECT p_partkey, 'columns' FROM parts WHERE contains(lower(run), 'brand#1') AND (contains('size=' || size, 'size=2') OR contains('type=' || lower(name), 'size=2'))")
def e6_search(spark, sf_dir):
    rows = _parts(spark, sf_dir)
    return lookup.search(rows, "promo").select("p_partkey", F.lit("text").alias("kind")).union(lookup.search(rows, "%run Brand#1 %par size=2 %zzz x").select("p_partkey", F.lit("columns")))


@query(f"WITH {DERIVED} SELECT job_id, status FROM derived WHERE status IN ('Failed', 'Pending')", ALL)
def e7_where_status(spark, sf_dir):
    d = _derived(spark, sf_dir).select("job_id", "status")
    return lookup.where_status(d.select("job_id"), d, "Failed", "Pending")


@query(f"WITH {PARTS} SELECT p_partkey FROM parts WHERE contains(job_id, '12')")
def e8_where_stage(spark, sf_dir):
    return lookup.where_stage(_parts(spark, sf_dir), "12").select("p_partkey")


@query(f"""WITH {PARTS}, prefixes AS (SELECT DISTINCT lpad(CAST(p_partkey * 3 AS VARCHAR), 6, '0')[1:5] AS prefix FROM part)
SELECT prefix, count(job_id) AS n, CASE count(job_id) WHEN 0 THEN 'not found' WHEN 1 THEN 'match' ELSE 'ambiguous' END AS result, min(job_id) AS first, max(job_id) AS last FROM prefixes LEFT JOIN parts ON starts_with(job_id, prefix) GROUP BY prefix""")
def e9_lookup(spark, sf_dir):
    rows = _parts(spark, sf_dir)
    prefixes = rows.select(F.substring(F.lpad((F.col("p_partkey") * 3).cast("string"), 6, "0"), 1, 5).alias("prefix")).distinct()
    return lookup.lookup(rows, prefixes, 5)


@query("SELECT DISTINCT p_brand AS run FROM part WHERE p_brand IN ('Brand#13', 'Brand#14')")
def e10_select_runs(spark, sf_dir):
    runs = _parts(spark, sf_dir).select("run").distinct()
    groups = runs.filter("run in ('Brand#13', 'Brand#14')").select(F.lit("some").alias("group"), "run")
    return lookup.select_runs(runs, groups, "@some")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS missing, CASE WHEN event_type <> 'view' THEN value::BIGINT::VARCHAR END AS inner_ FROM events")
def e11_get_path(spark, sf_dir):
    nested = F.to_json(F.struct(F.struct(F.when(F.col("event_type") != "view", F.rint("value").cast("long")).alias("x y")).alias("a")))
    return read(spark, sf_dir, "events").select("event_id", get_path(F.col("props"), "k").alias("k"), get_path(F.col("props"), "k.inner").alias("missing"), get_path(nested, "a.x y").alias("inner_"))


@query("SELECT o.job_id, o.name, max(v) FILTER (k = 'prio') AS prio, max(v) FILTER (k = 'tag') AS tag FROM dag_nodes o LEFT JOIN dag_params p USING (job_id) GROUP BY o.job_id, o.name", "dag_nodes dag_params")
def e12_to_table(spark, sf_dir):
    return lookup.to_table(bound(spark, sf_dir, "dag_nodes"), bound(spark, sf_dir, "dag_params"), ["prio", "tag"])


@query("SELECT p_partkey, p_name FROM part ORDER BY p_type, p_partkey LIMIT 50 OFFSET 30")
def e13_positions(spark, sf_dir):
    return lookup.at_positions(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), ["p_type", "p_partkey"], 30, 80).select("p_partkey", "p_name")


@query("SELECT l_orderkey AS job_id, arg_max(run, ord) AS run FROM (SELECT l_orderkey, 'run' || l_linenumber AS run, max(l_linenumber) AS ord FROM lineitem GROUP BY ALL) GROUP BY 1 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def e14_run_of(spark, sf_dir):
    runs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.concat(F.lit("run"), F.col("l_linenumber").cast("string")).alias("run"), F.col("l_linenumber").alias("ord"))
    return lookup.run_of(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id")), runs)


@query("SELECT DISTINCT run FROM turn_nodes WHERE starts_with(job_id, 'k1')", "turn_nodes")
def e15_runs_of_prefix(spark, sf_dir):
    return lookup.runs_of_prefix(bound(spark, sf_dir, "turn_nodes"), "k1")


@query("SELECT regexp_extract(job_id, '^[^-]*-(.+)-', 1) AS stage, count(*) AS n, min(job_id) AS first FROM (SELECT p_partkey || '-' || p_brand || '-1.' || p_size AS job_id FROM part) GROUP BY 1")
def e16_group_by_stage(spark, sf_dir):
    return lookup.group_by_stage(bound(spark, sf_dir, "SELECT p_partkey || '-' || p_brand || '-1.' || p_size AS job_id FROM part"))


@query("SELECT stage, row_number() OVER (PARTITION BY stage ORDER BY job_id) - 1 AS ord, job_id FROM (SELECT regexp_extract(job_id, '^[^-]*-(.+)-', 1) AS stage, job_id FROM (SELECT p_partkey || '-' || p_brand || '-1.' || p_size AS job_id FROM part))")
def e16_stage_members(spark, sf_dir):
    return lookup.stage_members(bound(spark, sf_dir, "SELECT p_partkey || '-' || p_brand || '-1.' || p_size AS job_id FROM part"))


@query("""SELECT n.job_id, n.run, (SELECT string_agg(k || '=' || v, ',' ORDER BY k) FROM dag_params p WHERE p.job_id = n.job_id) AS params,
(SELECT string_agg(DISTINCT dep_id, ',' ORDER BY dep_id) FROM dag_edges e WHERE e.job_id = n.job_id) AS inputs, CASE name WHEN 'line' THEN 'Failed' ELSE 'Pending' END AS status, 'data,log' AS outputs,
CASE name WHEN 'supplier' THEN 'gather:4G,main:1G' WHEN 'order' THEN 'main:1G' END AS hints FROM dag_nodes n""", "dag_nodes dag_params dag_edges")
def e18_job_profile(spark, sf_dir):
    nodes = checkpoint(bound(spark, sf_dir, "dag_nodes"))
    states, outputs = nodes.select("job_id", F.when(F.col("name") == "line", "Failed").otherwise("Pending").alias("status")), nodes.select("job_id", F.explode(F.array(F.lit("log"), F.lit("data"))).alias("output"))
    own = nodes.filter("name in ('supplier', 'order')").select("job_id", F.lit("main").alias("exe"), F.lit("1G").alias("mem")).union(nodes.filter("name = 'supplier'").select("job_id", F.lit("gather"), F.lit("4G")))
    hints = own.withColumns({"cpus": F.lit(None).cast("int"), "time": F.lit(None).cast("string")})
    wide = lookup.job_profile(nodes, states, bound(spark, sf_dir, "dag_params"), bound(spark, sf_dir, "dag_edges"), outputs, hints)
    given = F.array_join(F.transform("hints", lambda h: F.concat(h["exe"], F.lit(":"), h["mem"])), ",").alias("hints")
    return wide.select("job_id", "run", "status", F.array_join("outputs", ",").alias("outputs"), given, F.array_join(F.transform("params", lambda p: F.concat(p["k"], F.lit("="), p["v"])), ",").alias("params"), F.array_join("inputs", ",").alias("inputs"))


@query("""SELECT p_type AS "group", count(DISTINCT p_brand) AS runs FROM part GROUP BY 1""")
def e19_group_sizes(spark, sf_dir):
    return lookup.group_sizes(read(spark, sf_dir, "part").select(F.col("p_type").alias("group"), F.col("p_brand").alias("run")))


@query("SELECT job_id, count(*) AS n FROM (SELECT DISTINCT job_id, dep_id FROM dag_edges) GROUP BY job_id", "dag_edges")
def f1_parent_counts(spark, sf_dir):
    return lineage.parents(bound(spark, sf_dir, "dag_edges")).groupBy("job_id").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_type = 'SMALL'")
def e3_unknown_operator(spark, sf_dir):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return lookup.where(_parts(spark, sf_dir), name__near="SMALL").select("p_partkey")
