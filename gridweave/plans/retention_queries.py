"""Queries over roots, stores, manifests, caches and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions.ids import mem_to_bytes, root_hash
from gridweave.operators import retention, rules
from gridweave.plans.base import bound, query, read

KEPT = "kept AS (SELECT name, kind, project, target FROM (SELECT *, row_number() OVER (PARTITION BY project, kind ORDER BY name DESC) AS k FROM roots_fx) WHERE kind = 'pinned' OR k <= 5)"


def _roots(spark, sf_dir):
    return bound(spark, sf_dir, "roots_fx")


def _refs(spark, sf_dir):
    return bound(spark, sf_dir, "refs_fx")


def _store(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("artifact"), F.when(F.col("p_size") == 1, "bin").otherwise(F.col("p_type")).alias("kind"), F.col("p_size").cast("long").alias("size"))


@query(f"WITH {KEPT} SELECT DISTINCT artifact FROM kept JOIN refs_fx USING (target) UNION SELECT target FROM kept WHERE target NOT IN (SELECT target FROM refs_fx)", "roots_fx refs_fx")
def j1_live_set(spark, sf_dir):
    return retention.live_set(retention.keep_last_n(_roots(spark, sf_dir)), _refs(spark, sf_dir))


@query("""WITH live AS (SELECT artifact FROM roots_fx JOIN refs_fx USING (target) WHERE kind = 'pinned'), store AS (SELECT p_partkey AS artifact, CASE WHEN p_size = 1 THEN 'bin' ELSE p_type END AS kind, p_size AS size FROM part)
SELECT kind, count(*) AS dead, sum(size)::BIGINT AS bytes FROM store WHERE kind <> 'bin' AND artifact NOT IN (SELECT artifact FROM live) AND artifact NOT IN (SELECT target FROM roots_fx WHERE kind = 'pinned' AND target NOT IN (SELECT target FROM refs_fx)) GROUP BY kind""", "roots_fx refs_fx")
def j2_j7_sweep_report(spark, sf_dir):
    return retention.sweep_report(_store(spark, sf_dir), retention.pinned_only(_roots(spark, sf_dir), _refs(spark, sf_dir)))


@query(f"WITH {KEPT} SELECT name, kind, project, target FROM kept", "roots_fx")
def j3_keep_last_n(spark, sf_dir):
    return retention.keep_last_n(_roots(spark, sf_dir)).select("name", "kind", "project", "target")


@query("""SELECT name FROM (SELECT 'log_' || CASE WHEN o_orderkey % 9 = 0 THEN 'odd' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END || '_' || o_orderkey AS name, o_orderkey, o_orderdate FROM orders ORDER BY 1 DESC LIMIT 500)
WHERE o_orderkey % 9 = 0 OR date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-09-01') <= 100""")
def j4_keep_n_and_max_age(spark, sf_dir):
    logs = bound(spark, sf_dir, "SELECT 'log_' || CASE WHEN o_orderkey % 9 = 0 THEN 'odd' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END || '_' || o_orderkey AS name FROM orders")
    return retention.keep_n_and_max_age(logs, 500, 100, F.lit("1998-09-01").cast("date"))


@query("SELECT name, target FROM roots_fx WHERE kind = 'pinned' AND contains(project, '1')", "roots_fx")
def j5_list_roots(spark, sf_dir):
    return retention.list_roots(_roots(spark, sf_dir), "pinned", "1").select("name", "target")


@query("SELECT name, coalesce(sum(p_size), 0)::BIGINT AS bytes FROM roots_fx LEFT JOIN refs_fx USING (target) LEFT JOIN part ON p_partkey = artifact GROUP BY name", "roots_fx refs_fx")
def j6_root_size(spark, sf_dir):
    return retention.root_size(_roots(spark, sf_dir), _refs(spark, sf_dir), _store(spark, sf_dir).select("artifact", "size"))


@query("""SELECT lpad(CAST(n_nationkey * 37 AS VARCHAR), 4, '0') AS id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (kind = 'pinned'), '') AS pins, count(*) FILTER (kind = 'auto') AS autos
FROM nation LEFT JOIN roots_fx ON contains(name, lpad(CAST(n_nationkey * 37 AS VARCHAR), 4, '0')) OR contains(CAST(target AS VARCHAR), lpad(CAST(n_nationkey * 37 AS VARCHAR), 4, '0')) GROUP BY 1""", "roots_fx")
def j8_pin_status(spark, sf_dir):
    ids = bound(spark, sf_dir, "SELECT lpad(CAST(n_nationkey * 37 AS STRING), 4, '0') AS id FROM nation")
    return retention.pin_status(_roots(spark, sf_dir), ids)


@query("SELECT name, CASE kind WHEN 'auto' THEN substr(name, 21) ELSE name END AS hash FROM roots_fx", "roots_fx")
def j9_root_hash(spark, sf_dir):
    return _roots(spark, sf_dir).select("name", root_hash(F.col("name"), F.col("kind")).alias("hash"))


@query("""SELECT k.doc_id AS id, CASE WHEN d.doc_id IS NULL OR l.doc_id IS NULL THEN 'miss' WHEN k.lang = 'en' AND l.quality <> l.toxic THEN 'stale' ELSE 'hit' END AS state
FROM documents k LEFT JOIN (SELECT doc_id FROM documents WHERE n_chars > 200) d USING (doc_id) LEFT JOIN labels l ON l.doc_id = k.doc_id""")
def j10_freshness(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    keys = docs.select(F.col("doc_id").alias("id"), (F.col("lang") == "en").alias("kind_checked")).join(labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("expected")), "id", "left")
    return retention.freshness(keys, docs.filter("n_chars > 200").select(F.col("doc_id").alias("id")), labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("stored")))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j11_filter_missing(spark, sf_dir):
    return retention.filter_missing(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("SELECT event_type AS key_type, grouping(event_type) = 1 AS total, count(*) AS entries, coalesce(sum(CASE WHEN user_id % 3 > 0 THEN event_id END), 0)::BIGINT AS bytes, min(event_id) AS oldest, max(event_id) AS newest FROM events GROUP BY ROLLUP (event_type)")
def j12_cache_stats(spark, sf_dir):
    entries = read(spark, sf_dir, "events").select(F.col("event_type").alias("key_type"), F.when(F.col("user_id") % 3 > 0, F.col("event_id")).alias("size_bytes"), F.col("event_id").alias("created_at"))
    return retention.cache_stats(entries)


@query("""SELECT path, CASE WHEN m.sha256 IS NULL THEN 'extra' WHEN s.sha256 IS NULL THEN 'missing' WHEN m.sha256 = s.sha256 THEN 'ok' ELSE 'mismatch' END AS state
FROM manifest_fx m FULL JOIN (SELECT doc_id AS path, sha256(text) AS sha256 FROM documents) s USING (path)""", "manifest_fx")
def j13_verify_manifest(spark, sf_dir):
    store = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    return retention.verify_manifest(bound(spark, sf_dir, "manifest_fx"), store).select("path", "state")


@query("SELECT id, sha256(arg_min(text, src)) AS sha256 FROM (SELECT item_id AS id, text, 0 AS src FROM benchmark UNION ALL SELECT doc_id, text, 1 FROM documents) GROUP BY id")
def j14_merge_first_wins(spark, sf_dir):
    a, b = (read(spark, sf_dir, t).select(F.col(k).alias("id"), "text") for t, k in (("benchmark", "item_id"), ("documents", "doc_id")))
    return retention.merge_first_wins([a, b], "id").select("id", F.sha2("text", 256).alias("sha256"))


@query("""WITH m AS (SELECT p_partkey, r.* FROM part JOIN rules_fx r ON (r.target IS NULL OR r.target = p_brand) AND (r.pat IS NULL OR p_type GLOB r.pat))
SELECT p_partkey, arg_max(mem, ord) FILTER (mem IS NOT NULL) AS mem, arg_max(cpus, ord) FILTER (cpus IS NOT NULL) AS cpus FROM m GROUP BY p_partkey""", "rules_fx")
def j15_resolve_rules(spark, sf_dir):
    table = bound(spark, sf_dir, "rules_fx").withColumnRenamed("pat", "glob")
    return rules.resolve_rules(read(spark, sf_dir, "part"), table, "p_partkey", "p_type", "p_brand", ["mem", "cpus"])


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_size::BIGINT * 1073741824 WHEN 1 THEN p_size::BIGINT * 1048576 WHEN 2 THEN p_size::BIGINT * 1024 WHEN 3 THEN p_size::BIGINT END AS bytes FROM part")
def j17_mem_to_bytes(spark, sf_dir):
    text = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ("g", "M", "k ", "", "X"))), (F.col("p_size") % 5 + 1)))
    return read(spark, sf_dir, "part").select("p_partkey", mem_to_bytes(text).alias("bytes"))


@query("""SELECT name, kind FROM roots_fx WHERE NOT (kind = 'pinned' AND project = '0')""", "roots_fx")
def j18_unpin(spark, sf_dir):
    roots = _roots(spark, sf_dir)
    left, _ = retention.unpin(roots, roots.filter("project = '0'").select("name").union(spark.sql("SELECT 'no such root'")))
    return left.select("name", "kind")


@query("""WITH new AS (SELECT name, target + 1 AS target, project FROM roots_fx WHERE kind = 'pinned' UNION ALL SELECT 'new' || target, target, project FROM roots_fx WHERE project = '3'), good AS (SELECT * FROM new WHERE target IN (SELECT target FROM refs_fx))
SELECT name, 'pinned' AS kind, project, target FROM good UNION ALL SELECT name, kind, project, target FROM roots_fx WHERE name NOT IN (SELECT name FROM good)
UNION ALL SELECT name, 'no target', project, target FROM new WHERE target NOT IN (SELECT target FROM refs_fx)""", "roots_fx refs_fx")
def j18_pin(spark, sf_dir):
    roots = _roots(spark, sf_dir)
    new = roots.filter("kind = 'pinned'").select("name", (F.col("target") + 1).alias("target"), "project").union(roots.filter("project = '3'").select(F.concat(F.lit("new"), F.col("target").cast("string")), "target", "project"))
    after, missing = retention.pin(roots, new, _refs(spark, sf_dir))
    return after.union(missing.select("name", F.lit("no target"), "project", "target"))


@query("""WITH m AS (SELECT p_partkey, r.* FROM part JOIN rules_fx r ON (r.target IS NULL OR r.target = p_brand) AND (r.pat IS NULL OR p_type GLOB r.pat)),
b AS (SELECT p_partkey, arg_max(mem, ord) FILTER (mem IS NOT NULL) AS mem, arg_max(cpus, ord) FILTER (cpus IS NOT NULL) AS cpus, max(ord) AS last FROM m GROUP BY p_partkey)
SELECT p_partkey, CASE WHEN last = 1 THEN '9G' ELSE mem END AS mem, CASE WHEN last = 3 THEN 16 WHEN p_size > 40 THEN p_size ELSE cpus END AS cpus FROM b JOIN part USING (p_partkey)""", "rules_fx")
def j16_resolve_worker_rules(spark, sf_dir):
    table = bound(spark, sf_dir, "rules_fx").withColumnRenamed("pat", "glob")
    table = table.withColumn("worker", F.struct(F.when(F.col("ord") == 1, "9G").alias("mem"), F.when(F.col("ord") == 3, 16).alias("cpus")))
    part = read(spark, sf_dir, "part").withColumn("worker_cpus", F.when(F.col("p_size") > 40, F.col("p_size")))
    return rules.resolve_worker_rules(part, table, "p_partkey", "p_type", "p_brand", ["mem", "cpus"])


_FILES = "files AS (SELECT CASE p_size % 3 WHEN 0 THEN 'store/' || p_brand || '/' || p_partkey WHEN 1 THEN p_type || '/' || p_partkey ELSE 'bin/' || p_partkey END AS path, p_size AS size, p_brand, p_type FROM part)"


@query(f"""WITH {_FILES}, live AS (SELECT 'store/' || p_brand AS a FROM part JOIN refs_fx ON artifact = p_partkey JOIN roots_fx USING (target) WHERE kind = 'pinned' UNION SELECT p_type FROM part JOIN refs_fx ON artifact = p_partkey JOIN roots_fx USING (target) WHERE kind = 'pinned'),
e AS (SELECT CASE WHEN path LIKE 'store/%' THEN 'store/' || p_brand ELSE split_part(path, '/', 1) END AS a, split_part(path, '/', 1) AS kind, sum(size) AS size FROM files GROUP BY ALL)
SELECT kind, count(*) AS dead, sum(size)::BIGINT AS bytes FROM e WHERE kind <> 'bin' AND a NOT IN (SELECT a FROM live) GROUP BY kind
UNION ALL SELECT 'outputs', count(*), coalesce(sum(p_size), 0)::BIGINT FROM part WHERE p_partkey NOT IN (SELECT artifact FROM refs_fx JOIN roots_fx USING (target) WHERE kind = 'pinned')""", "roots_fx refs_fx")
def j2_store_report(spark, sf_dir):
    """Collections one level down, top folders of live artifacts, and outputs of jobs that no pinned root has."""
    part, pinned = read(spark, sf_dir, "part"), _roots(spark, sf_dir).filter("kind = 'pinned'")
    refs = _refs(spark, sf_dir).join(part, F.col("artifact") == F.col("p_partkey"))
    paths = refs.select("target", F.explode(F.array(F.concat(F.lit("store/"), "p_brand"), F.concat("p_type", F.lit("/"), F.col("p_partkey").cast("string")))).alias("artifact"))
    key = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("store/"), "p_brand", F.lit("/"), key)).when(F.col("p_size") % 3 == 1, F.concat("p_type", F.lit("/"), key)).otherwise(F.concat(F.lit("bin/"), key))
    store = retention.store_entries(part.select(path.alias("path"), F.col("p_size").alias("size")))
    dead = retention.sweep_report(store, retention.live_paths(pinned, paths))
    outputs = part.select(F.col("p_partkey").alias("job_id"), F.col("p_size").alias("size"))
    return dead.union(retention.outputs_report(outputs, retention.live_jobs(pinned, refs.select("target", F.col("p_partkey").alias("job_id")))))


@query("WITH r AS (SELECT name, coalesce(sum(p_size), 0)::BIGINT AS bytes FROM roots_fx LEFT JOIN refs_fx USING (target) LEFT JOIN part ON p_partkey = artifact WHERE kind = 'pinned' GROUP BY name) SELECT name, bytes FROM r UNION ALL SELECT NULL, sum(bytes)::BIGINT FROM r", "roots_fx refs_fx")
def j5_roots_with_size(spark, sf_dir):
    return retention.roots_with_size(_roots(spark, sf_dir), _refs(spark, sf_dir), _store(spark, sf_dir).select("artifact", "size"), "pinned")
