"""Query registration, and the bindings that give the driver's tables the shapes of catalogs, graphs and logs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: The same SQL for Spark and DuckDB but for ``sha256``.
BINDINGS = {
    "dag_edges": """SELECT 'n:' || n_nationkey AS job_id, 0 AS pos, 'r:' || n_regionkey AS dep_id FROM nation
UNION ALL SELECT 'c:' || c_custkey, 0, 'n:' || c_nationkey FROM customer
UNION ALL SELECT 's:' || s_suppkey, 0, 'n:' || s_nationkey FROM supplier
UNION ALL SELECT 'o:' || o_orderkey, 0, 'c:' || o_custkey FROM orders
UNION ALL SELECT DISTINCT 'l:' || l_orderkey || ':' || l_suppkey, 0, 'o:' || l_orderkey FROM lineitem
UNION ALL SELECT DISTINCT 'l:' || l_orderkey || ':' || l_suppkey, 1, 's:' || l_suppkey FROM lineitem""",
    "dag_params": """SELECT 'r:' || r_regionkey AS job_id, 'name' AS k, r_name AS v FROM region
UNION ALL SELECT 'n:' || n_nationkey, 'name', n_name FROM nation
UNION ALL SELECT 'c:' || c_custkey, 'segment', c_mktsegment FROM customer
UNION ALL SELECT 'c:' || c_custkey, 'tag', 'c' || c_custkey FROM customer
UNION ALL SELECT 's:' || s_suppkey, 'tag', 's' || s_suppkey FROM supplier
UNION ALL SELECT 'o:' || o_orderkey, 'prio', o_orderpriority FROM orders""",
    "dag_nodes": """SELECT 'r:' || r_regionkey AS job_id, 'region' AS name, 'r' AS run FROM region
UNION ALL SELECT 'n:' || n_nationkey, 'nation', 'r' FROM nation
UNION ALL SELECT 'c:' || c_custkey, 'customer', 'o' FROM customer
UNION ALL SELECT 's:' || s_suppkey, 'supplier', 's' FROM supplier
UNION ALL SELECT 'o:' || o_orderkey, 'order', 'o' FROM orders
UNION ALL SELECT DISTINCT 'l:' || l_orderkey || ':' || l_suppkey, 'line', 'l' FROM lineitem""",
    "turn_nodes": "SELECT DISTINCT 'k' || conv_id || ':' || turn AS job_id, 'run' || (conv_id % 10) AS run FROM conversations",
    "turn_edges": "SELECT DISTINCT 'k' || conv_id || ':' || turn AS job_id, 'k' || conv_id || ':' || (turn - 1) AS dep_id FROM conversations WHERE turn > 0",
    "completions_fx": """SELECT event_id AS seq, 'k' || (event_id % (SELECT max(conv_id) + 1 FROM conversations)) || ':' || ((user_id * 3 + event_id) % (SELECT max(turn) + 1 FROM conversations)) AS job_id,
CASE WHEN event_type = 'error' THEN 'fail' ELSE 'ok' END AS s
FROM events WHERE event_type IN ('error', 'purchase', 'signup')""",
    "live_fx": """SELECT event_id AS seq, 'k' || (event_id % (SELECT max(conv_id) + 1 FROM conversations)) || ':' || ((user_id * 3 + event_id) % (SELECT max(turn) + 1 FROM conversations)) AS job_id,
CASE WHEN event_type = 'click' THEN 'Running' ELSE 'Queued' END AS state
FROM events WHERE event_type IN ('click', 'view')""",
    "branches_fx": """SELECT l_orderkey AS job_id,
CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS branch_idx,
CAST(l_quantity AS BIGINT) AS x, l_partkey FROM lineitem""",
    "roots_fx": """SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) || '_' || lpad(CAST(o_orderkey AS STRING), 10, '0') AS name,
CASE WHEN o_orderkey % 200 = 0 THEN 'pinned' ELSE 'auto' END AS kind,
CAST(o_custkey % 25 AS STRING) AS project, o_orderkey AS target FROM orders""",
    "refs_fx": "SELECT DISTINCT l_orderkey AS target, l_partkey AS artifact FROM lineitem",
    "manifest_fx": "SELECT d.doc_id AS path, CASE WHEN toxic = 1 THEN 'bad' ELSE sha256(text) END AS sha256 FROM documents AS d JOIN labels ON d.doc_id = labels.doc_id UNION ALL SELECT -1 - item_id, sha256(text) FROM benchmark",
    "rules_fx": """SELECT * FROM (VALUES (0, CAST(NULL AS STRING), CAST(NULL AS STRING), '1G', CAST(1 AS INT)), (1, 'PROMO*', NULL, '4G', NULL),
(2, '*M*', 'Brand#13', NULL, 8), (3, 'S?ALL', NULL, '2G', 2)) AS r(ord, pat, target, mem, cpus)""",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound(spark: SparkSession, sf_dir: str, name_or_sql: str) -> DataFrame:
    """A binding's rows, or those of a SQL text, over the Parquet tables."""
    text = BINDINGS.get(name_or_sql, name_or_sql).replace("sha256(text)", "sha2(text, 256)")
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b( AS \w+)?", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet` {m[3] or f'AS {m[2]}'}", text))


def query(sql: str | None = None, using: str = ""):
    """Registers a function (spark, sf_dir) under its name; ``using`` names bindings that the SQL refers to."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            named = [f"{n} AS ({BINDINGS[n]})" for n in using.split()]
            rest = sql.strip()
            if named and rest.upper().startswith("WITH RECURSIVE "):
                SQL[f.__name__] = "WITH RECURSIVE " + ", ".join(named) + ", " + rest[15:]
            elif named and rest.upper().startswith("WITH "):
                SQL[f.__name__] = "WITH " + ", ".join(named) + ", " + rest[5:]
            else:
                SQL[f.__name__] = ("WITH " + ", ".join(named) + " " if named else "") + rest
        return f

    return register
