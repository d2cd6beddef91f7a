"""Queries over parameter grids, content keys, sweeps and fan-outs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions.ids import DIGITS, canonical_params, content_id, short_id, stage_of
from gridweave.operators import fanout, grid, identity, sweep
from gridweave.operators.identity import Stage
from gridweave.operators.sweep import SweepStage
from gridweave.plans.base import bound, query, read
from gridweave.shared import checkpoint, numbered, small


def base32_sql(digest: str, keep: int = 32) -> str:
    """DuckDB SQL for the first base-32 digits of a hex digest."""
    byte = lambda i: f"coalesce((instr('0123456789abcdef', substr({digest}, 2 * ({i}) + 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr({digest}, 2 * ({i}) + 2, 1)) - 1, 0)"
    hi = f"CASE WHEN (n * 5) // 8 + 1 > 31 THEN 0 ELSE {byte('(n * 5) // 8 + 1')} END"
    return f"array_to_string(list_transform(range(51, {51 - keep}, -1), lambda n: substr('{DIGITS}', ((({byte('(n * 5) // 8')} + 256 * ({hi})) >> ((n * 5) % 8)::INT) & 31)::INT + 1, 1)), '')"


def key_sql(identity_: str, params: str, deps: list[str], name: str, version: str = "1.0", mappings: str = "[]") -> str:
    deps_json = "'[' || " + " || ',' || ".join(f"'\"' || {d} || '\"'" for d in deps) + " || ']'" if deps else "'[]'"
    joined = " || ':' || ".join(deps) if deps else "''"
    text = f"'{identity_}' || 'x00' || {params} || 'x00' || {deps_json} || 'x00' || sha256({joined}) || 'x00' || '{mappings}'"
    return f"{base32_sql(f'sha256({text})')} || '-{name}-{version}'"


FLAGS = grid.axis_zip(flag=["A", "R"], min_qty=[10.0, 25.0])
DISCOUNTS = grid.axis_list("max_discount", [0.03, 0.06, 0.10])
GRID_SQL = """grid AS (SELECT (d.ord * 2 + z.ord)::BIGINT AS combo_id, d.v::DOUBLE AS max_discount, z.flag, z.q::DOUBLE AS min_qty
FROM (VALUES (0, 0.03), (1, 0.06), (2, 0.10)) AS d(ord, v) CROSS JOIN (VALUES (0, 'A', 10), (1, 'R', 25)) AS z(ord, flag, q))"""


@query("SELECT q.v::BIGINT AS quantity, count(l_orderkey) AS lines FROM range(1, 51) AS q(v) LEFT JOIN lineitem ON l_quantity = q.v GROUP BY q.v")
def b1_axis_range(spark, sf_dir):
    axis = grid.expand_grid(spark, [grid.axis_range("quantity", 1, 50)])
    counts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("quantity")).agg(F.count("*").alias("lines"))
    return axis.join(counts, "quantity", "left").select(F.col("quantity").cast("long").alias("quantity"), F.coalesce("lines", F.lit(0)).alias("lines"))


@query("SELECT row_number() OVER (ORDER BY p_type, p_brand) - 1 AS combo, p_type, p_brand FROM (SELECT DISTINCT p_type FROM part), (SELECT DISTINCT p_brand FROM part)")
def b2_axis_column(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return grid.expand_grid(spark, [grid.axis_column(part, "p_type"), grid.axis_column(part, "p_brand")]).withColumnRenamed("combo_id", "combo")


@query("SELECT z.flag, z.min_qty, count(l_orderkey) AS lines FROM (VALUES ('A', 10.0), ('R', 25.0)) AS z(flag, min_qty) LEFT JOIN lineitem ON l_returnflag = z.flag AND l_quantity >= z.min_qty GROUP BY ALL")
def b3_axis_zip(spark, sf_dir):
    axis = small(grid.expand_grid(spark, [FLAGS]))
    return read(spark, sf_dir, "lineitem").join(axis, (F.col("l_returnflag") == F.col("flag")) & (F.col("l_quantity") >= F.col("min_qty"))).groupBy("flag", "min_qty").agg(F.count("*").alias("lines"))


@query(f"WITH {GRID_SQL} SELECT combo_id, max_discount, flag, min_qty, count(l_orderkey) AS lines FROM grid LEFT JOIN lineitem ON l_returnflag = flag AND l_quantity >= min_qty AND l_discount <= max_discount GROUP BY ALL")
def b5_expand_grid(spark, sf_dir):
    combos = grid.expand_grid(spark, [DISCOUNTS, FLAGS])
    hit = (F.col("l_returnflag") == F.col("flag")) & (F.col("l_quantity") >= F.col("min_qty")) & (F.col("l_discount") <= F.col("max_discount"))
    counts = read(spark, sf_dir, "lineitem").join(small(combos), hit).groupBy("combo_id").agg(F.count("*").alias("lines"))
    return combos.join(counts, "combo_id", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))


@query("""WITH g AS (SELECT (q.v - 1) * 3 + f.o AS combo_id, q.v::BIGINT AS quantity, f.flag FROM range(1, 51) AS q(v), (VALUES (0, 'A'), (1, 'N'), (2, 'R')) AS f(o, flag))
SELECT combo_id, quantity, flag, count(l_orderkey) AS lines FROM g LEFT JOIN lineitem ON l_quantity = quantity AND l_returnflag = flag WHERE combo_id BETWEEN 40 AND 119 GROUP BY ALL""")
def b6_grid_slice(spark, sf_dir):
    part = grid.grid_slice(spark, [grid.axis_range("quantity", 1, 50), grid.axis_list("flag", ["A", "N", "R"])], 40, 120)
    counts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("quantity"), F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("lines"))
    return part.join(counts, ["quantity", "flag"], "left").select("combo_id", F.col("quantity").cast("long").alias("quantity"), "flag", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("SELECT p_partkey AS combo_id, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, 7) AS size, 'fast' AS mode FROM part")
def b9_resolve_defaults(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("combo_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("size"), F.col("p_brand").alias("undeclared"))
    return grid.resolve_defaults(rows, {"size": 7, "mode": "fast"})


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS class, p_brand || '-' || p_size AS label FROM part")
def b10_derive_params(spark, sf_dir):
    rows = grid.derive_params(read(spark, sf_dir, "part"), **{"class": F.when(F.col("p_size") > 25, "large").otherwise("small"), "label": F.format_string("%s-%d", "p_brand", "p_size")})
    return rows.select("p_partkey", "class", "label")


@query("SELECT p_partkey, pipeline, pos, stage, row_number() OVER (ORDER BY p_partkey, pipeline, pos) - 1 AS ord FROM part, (VALUES ('pa', 0, 'clean'), ('pa', 1, 'sum'), ('pb', 0, 'sum')) AS s(pipeline, pos, stage)")
def b11_cross_pipelines(spark, sf_dir):
    stages = spark.createDataFrame([("pa", 0, "clean"), ("pa", 1, "sum"), ("pb", 0, "sum")], "pipeline string, pos int, stage string")
    return numbered(grid.cross_pipelines(read(spark, sf_dir, "part").select("p_partkey"), stages), ["p_partkey", "pipeline", "pos"])


@query("SELECT p_type, p_brand, p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY CASE WHEN p_size > 45 THEN 0 ELSE 1 END, CASE WHEN p_brand = 'Brand#13' THEN 0 ELSE 1 END, p_partkey) AS k FROM part) WHERE k = 1")
def b12_pick_representatives(spark, sf_dir):
    return grid.pick_representatives(read(spark, sf_dir, "part"), "p_type", F.col("p_brand") == "Brand#13", F.col("p_size") > 45, "p_partkey").select("p_type", "p_brand", "p_name", "p_partkey")


_PART_JSON = """'{"brand":' || '"' || p_brand || '"' || ',"none":null,"size":' || p_size || '}'"""


@query(f"SELECT p_partkey, {_PART_JSON} AS params, {base32_sql(f'sha256({_PART_JSON})')} AS id FROM part")
def c1_c2_canonical_ids(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.lit(None).cast("string").alias("none"))
    rows = rows.withColumn("params", canonical_params(["size", "none", "brand"]))
    return rows.select("p_partkey", "params", content_id(F.col("params")).alias("id"))


LOAD = Stage("load", params={"brand": "none"})
CUT = Stage("cut", "2.1", {"size": 1}, ("load",))
REPORT = Stage("report", params={}, deps=("cut", "load"))
_CHAIN = f"""g AS (SELECT p_partkey AS combo_id, p_brand AS brand, p_size AS size, p_type AS type FROM part),
k1 AS (SELECT *, {key_sql('load-1.0', "'{{\"brand\":\"' || brand || '\"}}'".replace('{{', '{').replace('}}', '}'), [], 'load')} AS key_load FROM g),
k2 AS (SELECT *, {key_sql('cut-2.1', "'{\"size\":' || size || '}'", ['key_load'], 'cut', '2.1')} AS key_cut FROM k1),
k3 AS (SELECT *, {key_sql('report-1.0', "'{}'", ['key_cut', 'key_load'], 'report')} AS key_report FROM k2)"""


def _parts(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("combo_id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("type"))


@query(f"WITH {_CHAIN} SELECT combo_id, key_load, key_cut, key_report FROM k3")
def c4_c5_propagate_keys(spark, sf_dir):
    return identity.propagate_keys(_parts(spark, sf_dir), [LOAD, CUT, REPORT]).select("combo_id", "key_load", "key_cut", "key_report")


@query("""SELECT 'load' AS stage, count(*) AS total, count(DISTINCT p_brand) AS "unique" FROM part
UNION ALL SELECT s, count(*), count(DISTINCT (p_brand, p_size)) FROM part, (VALUES ('cut'), ('report')) AS t(s) GROUP BY s""")
def c6_dedup_jobs(spark, sf_dir):
    return identity.dedup_report(identity.propagate_keys(_parts(spark, sf_dir), [LOAD, CUT, REPORT]), [LOAD, CUT, REPORT])


@query("""SELECT stage, status, count(*) AS n FROM (
SELECT s.stage, CASE WHEN p_size < 8 AND p_retailprice > 1500 THEN NULL WHEN p_size < 8 THEN 'added' WHEN p_retailprice > 1500 THEN 'removed' WHEN s.stage = 'load' THEN 'same' ELSE 'changed' END AS status
FROM part, (VALUES ('load'), ('cut'), ('report')) AS s(stage)) WHERE status IS NOT NULL GROUP BY ALL""")
def c7_plan_diff(spark, sf_dir):
    def plan(rows, stages):
        keyed = identity.propagate_keys(rows, stages)
        return keyed.select("combo_id", F.explode(F.create_map(*[x for s in stages for x in (F.lit(s.name), F.col(f"key_{s.name}"))])).alias("stage", "key"))

    parts = _parts(spark, sf_dir).join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("combo_id"), "p_retailprice"), "combo_id")
    old = plan(parts.filter("size >= 8"), [LOAD, CUT, REPORT])
    new = plan(parts.filter("p_retailprice <= 1500"), [LOAD, Stage("cut", "2.2", {"size": 1}, ("load",)), REPORT])
    return identity.plan_diff(old, new).groupBy("stage", "status").agg(F.count("*").alias("n"))


def revenue_stages(lineitem):
    def select(inputs, params):
        hit = (F.col("l_returnflag") == F.col("flag")) & (F.col("l_quantity") >= F.col("min_qty")) & (F.col("l_discount") <= F.col("max_discount"))
        return lineitem.select("l_returnflag", "l_quantity", "l_discount", "l_extendedprice").join(small(params), hit).select("job_key", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))

    def revenue(inputs, params):
        return sweep.stage_sum(inputs["select"], "value")

    declared = {"max_discount": 0.1, "flag": "A", "min_qty": 0.0}
    return [SweepStage(Stage("select", params=declared), select), SweepStage(Stage("revenue", deps=("select",)), revenue)]


@query(f"WITH {GRID_SQL} SELECT combo_id, max_discount, flag, min_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM grid JOIN lineitem ON l_returnflag = flag AND l_quantity >= min_qty AND l_discount <= max_discount GROUP BY ALL")
def sweep_revenue(spark, sf_dir):
    done = sweep.run_sweep(grid.expand_grid(spark, [DISCOUNTS, FLAGS]), revenue_stages(read(spark, sf_dir, "lineitem")))
    return done.table("revenue", ["max_discount", "flag", "min_qty"]).select("combo_id", "max_discount", "flag", "min_qty", F.round("total", 2).alias("revenue"))


#: 11 discounts, 50 quantities and 3 flags: 1,650 combinations.
_THRESHOLDS = [sweep.Threshold("max_discount", "l_discount", "<=", tuple(k / 100 for k in range(11))), sweep.Threshold("min_qty", "l_quantity", ">=", tuple(float(k) for k in range(1, 51))), sweep.Threshold("flag", "l_returnflag", "=", ("A", "N", "R"))]


@query("""WITH c AS (SELECT l_discount, l_quantity, l_returnflag, count(*) AS n, sum(l_extendedprice::DECIMAL(12, 2)) AS v FROM lineitem GROUP BY ALL)
SELECT d / 100 AS max_discount, q::DOUBLE AS min_qty, flag, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(v), 0)::DOUBLE AS price FROM range(11) AS a(d), range(1, 51) AS b(q), (VALUES ('A'), ('N'), ('R')) AS f(flag)
LEFT JOIN c ON l_returnflag = flag AND l_quantity >= q AND l_discount <= d / 100 GROUP BY d, q, flag""")
def i11_threshold_sweep(spark, sf_dir):
    """Price over all combinations of discount, quantity and flag thresholds, by one scan of lineitem."""
    rows = read(spark, sf_dir, "lineitem").select("l_discount", "l_quantity", "l_returnflag", F.col("l_extendedprice").cast("decimal(12,2)").alias("p"))
    return sweep.threshold_sweep(rows, _THRESHOLDS, {"price": F.col("p")}).withColumn("price", F.col("price").cast("double"))


@query(f"""WITH {GRID_SQL}, r AS (SELECT flag, max_discount, round(sum(l_extendedprice * (1 - l_discount)), 2) AS v FROM grid JOIN lineitem ON l_returnflag = flag AND l_quantity >= min_qty AND l_discount <= max_discount GROUP BY ALL)
SELECT max_discount, max(v) FILTER (flag = 'A') AS "A", max(v) FILTER (flag = 'R') AS "R" FROM r GROUP BY max_discount""")
def i10_compare_sweep(spark, sf_dir):
    return sweep.compare_sweep(sweep_revenue(spark, sf_dir), "max_discount", "flag", "revenue", ["A", "R"])


@query("SELECT l_orderkey AS job_key, sum(l_quantity)::BIGINT AS total FROM lineitem GROUP BY 1")
def i1_stage_sum(spark, sf_dir):
    return sweep.stage_sum(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_key"), F.col("l_quantity").cast("long").alias("q")), "q")


_AB = "a AS (SELECT job_id AS job_key, branch_idx AS ord, x FROM branches_fx WHERE l_partkey % 2 = 0), b AS (SELECT job_id AS job_key, branch_idx AS ord, x FROM branches_fx WHERE l_partkey % 2 = 1)"
_BOTH = f"WITH {_AB}, u AS (SELECT job_key, x, row_number() OVER (PARTITION BY job_key ORDER BY part, ord) - 1 AS ord FROM (SELECT *, 0 AS part FROM a UNION ALL SELECT *, 1 FROM b))"


def _concat(spark, sf_dir):
    rows = bound(spark, sf_dir, "branches_fx").select(F.col("job_id").alias("job_key"), F.col("branch_idx").alias("ord"), "x", "l_partkey")
    return sweep.stage_concat(rows.filter("l_partkey % 2 = 0").drop("l_partkey"), rows.filter("l_partkey % 2 = 1").drop("l_partkey"))


@query(f"{_BOTH} SELECT job_key, ord, x FROM u", "branches_fx")
def i2_stage_concat(spark, sf_dir):
    return _concat(spark, sf_dir).select("job_key", "ord", "x")


@query(f"{_BOTH} SELECT job_key, ord, x FROM u WHERE ord = job_key % 4", "branches_fx")
def i3_row_at(spark, sf_dir):
    wanted = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_key"), (F.col("o_orderkey") % 4).alias("ord"))
    return sweep.row_at(_concat(spark, sf_dir), wanted).select("job_key", "ord", "x")


@query("SELECT n_nationkey::BIGINT AS nation, x::BIGINT AS x, (n_nationkey + x)::BIGINT AS line, (n_regionkey * x * x)::BIGINT AS curve, round(sin(x) + 2, 6) AS wave FROM nation, range(0, 20) AS r(x)")
def i5_generators(spark, sf_dir):
    params = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), F.col("n_regionkey").cast("long").alias("slope"))
    return sweep.generate(params, 20, line=F.expr("nation + x"), curve=F.expr("slope * x * x"), wave=F.round(F.sin("x") + 2, 6)).drop("slope")


@query("SELECT o_orderkey AS job_key, (coalesce((SELECT min(x) FROM branches_fx b WHERE b.job_id = o_orderkey AND branch_idx = 0), 0) * (o_custkey % 5))::BIGINT AS scaled FROM orders", "branches_fx")
def i6_stage_scale(spark, sf_dir):
    jobs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_key"), (F.col("o_custkey") % 5).alias("by"))
    first = bound(spark, sf_dir, "branches_fx").filter("branch_idx = 0").select(F.col("job_id").alias("job_key"), F.col("x").alias("value"))
    return sweep.stage_scale(jobs, first, "by")


@query("SELECT p_partkey, (p_size + p_size * 2 + 7 + 3 * (p_partkey % 4))::BIGINT AS total FROM part")
def i7_list_arg_reduce(spark, sf_dir):
    rows = read(spark, sf_dir, "part").withColumn("args", F.concat_ws("  ", F.col("p_size").cast("string"), (F.col("p_size") * 2).cast("string"), F.lit(" 7 ")))
    return rows.select("p_partkey", sweep.list_arg_reduce(F.col("args"), F.col("p_partkey") % 4).alias("total"))


@query("SELECT p_partkey, try_cast(regexp_replace(p_brand, 'Brand#', '') AS DOUBLE) AS number FROM part WHERE contains(p_type, 'O') AND p_partkey % 3 > 0")
def i8_collect_numeric(spark, sf_dir):
    value = F.when(F.col("p_partkey") % 3 > 0, F.regexp_replace("p_brand", "Brand#", "")).otherwise(F.col("p_brand"))
    return sweep.collect_numeric(read(spark, sf_dir, "part").withColumn("value", value), "p_type", "O", "value").select("p_partkey", "number")


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
c AS (SELECT least(floor((l_extendedprice - lo) * 10 / (hi - lo)) + 1, 10)::BIGINT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
SELECT b.v::BIGINT AS bin, round(lo + (hi - lo) / 10 * (b.v - 1), 4) AS low, round(lo + (hi - lo) / 10 * b.v, 4) AS high, coalesce(n, 0) AS n FROM range(1, 11) AS b(v), e LEFT JOIN c ON c.bin = b.v""")
def i9_histogram(spark, sf_dir):
    return sweep.histogram(read(spark, sf_dir, "lineitem"), "l_extendedprice").select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


@query("SELECT job_id, branch_idx, x AS item FROM branches_fx", "branches_fx")
def h1_scatter(spark, sf_dir):
    jobs = fanout.gather(bound(spark, sf_dir, "branches_fx"), "x")
    return fanout.scatter(jobs, "items").select("job_id", F.col("branch_idx").cast("long").alias("branch_idx"), "item")


def diamond() -> list[fanout.Step]:
    return [fanout.Step("square", value=F.col("x") * F.col("x")), fanout.Step("double", value=F.col("x") * 2), fanout.Step("combine", ("square", "double"), F.col("square") + F.col("double"))]


@query("SELECT job_id, branch_idx, x * x AS square, 2 * x AS double, x * x + 2 * x AS combine FROM branches_fx", "branches_fx")
def h2_i4_run_steps(spark, sf_dir):
    return fanout.run_steps(bound(spark, sf_dir, "branches_fx"), diamond()).select("job_id", "branch_idx", "square", "double", "combine")


@query("SELECT job_id, string_agg(CAST(x * x + 2 * x AS VARCHAR), ',' ORDER BY branch_idx) AS items, sum(x * x + 2 * x)::BIGINT AS total FROM branches_fx GROUP BY job_id", "branches_fx")
def h3_gather(spark, sf_dir):
    done = fanout.run_steps(bound(spark, sf_dir, "branches_fx"), diamond())
    total = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x)
    return fanout.gather(done, "combine").select("job_id", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), total.alias("total"))


def _opaque(branch):
    """Python code of a step: fails for one part in 97."""
    if branch["l_partkey"] % 97 == 0:
        raise ValueError(f"part {branch['l_partkey']}")
    return branch["square"] + branch["item"] % 7 + len(branch["rows"])


def _rolling(items):
    """A digest that depends on the order of its branches."""
    at = 0
    for _, x in items:
        at = (at * 31 + x) % 1_000_003
    return at


def _branches(spark, sf_dir):
    return bound(spark, sf_dir, "branches_fx").withColumnRenamed("x", "item")


def _coded_steps(branches):
    """A column step, and code that also reads a row for each branch of a large item."""
    more = branches.filter("item > 25").select("job_id", "branch_idx", "l_partkey")
    return (fanout.Step("square", value=F.col("item") * F.col("item")), fanout.Step("out", ("square",), code=_opaque, returns="long", reads=more))


@query("SELECT job_id, branch_idx, CASE WHEN l_partkey % 97 > 0 THEN x * x + x % 7 + CASE WHEN x > 25 THEN 1 ELSE 0 END END AS out, CASE WHEN l_partkey % 97 = 0 THEN 'ValueError: part ' || l_partkey END AS out_error FROM branches_fx", "branches_fx")
def h2_python_step(spark, sf_dir):
    branches = checkpoint(_branches(spark, sf_dir))  # numbered once
    return fanout.run_steps(branches, _coded_steps(branches)).select("job_id", "branch_idx", "out", "out_error")


@query("""WITH g AS (SELECT job_id, count(*) AS branches, count(*) FILTER (l_partkey % 97 > 0) AS done, min(branch_idx) FILTER (l_partkey % 97 = 0) AS first_missing, list(x * x + x % 7 + CASE WHEN x > 25 THEN 1 ELSE 0 END ORDER BY branch_idx) AS v FROM branches_fx GROUP BY job_id)
SELECT o_orderkey AS job_id, coalesce(branches, 0) AS branches, coalesce(done, 0) AS done, first_missing, first_missing IS NULL AS complete, CASE WHEN first_missing IS NULL THEN coalesce(list_reduce(v, lambda a, x: (a * 31 + x) % 1000003, 0::BIGINT), 0) END AS gathered FROM orders LEFT JOIN g ON job_id = o_orderkey""", "branches_fx")
def h3_fan_out(spark, sf_dir):
    """Orders scattered to their lines, code for each line, an ordered gather; orders without lines are gathered from none."""
    jobs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"))
    branches = checkpoint(_branches(spark, sf_dir))  # numbered once
    made = fanout.FanOut(lambda _: branches, _coded_steps(branches), _rolling, "long")
    return made.run(jobs).select("job_id", "branches", "done", "first_missing", "complete", "gathered")


@query("SELECT job_id, count(*) AS branches, count(*) FILTER (x < 48) AS done, min(branch_idx) FILTER (x >= 48) AS first_missing, bool_and(x < 48) AS complete FROM branches_fx GROUP BY job_id", "branches_fx")
def h4_completeness_gate(spark, sf_dir):
    return fanout.completeness_gate(bound(spark, sf_dir, "branches_fx"), F.col("x") < 48)


@query("SELECT job_id, branch_idx, CASE WHEN x > 45 THEN 'new' WHEN x < 5 THEN 'changed' ELSE 'same' END AS state FROM branches_fx", "branches_fx")
def h5_stale_branches(spark, sf_dir):
    now = bound(spark, sf_dir, "branches_fx").withColumnRenamed("x", "item")
    before = now.filter("item <= 45").withColumn("item", F.when(F.col("item") < 5, F.col("item") + 1).otherwise(F.col("item")))
    return fanout.stale_branches(before, now)


@query("SELECT job_id, sum(x)::BIGINT AS total, any_value(o_orderpriority) AS prio FROM branches_fx LEFT JOIN orders ON o_orderkey = job_id GROUP BY job_id", "branches_fx")
def h6_side_outputs(spark, sf_dir):
    gathered = bound(spark, sf_dir, "branches_fx").groupBy("job_id").agg(F.sum("x").alias("total"))
    return fanout.side_outputs(gathered, read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("prio")))


@query("SELECT job_id, 2 + 3 * count(*) AS units, 1 + count(*) FILTER (x < 48) AS finished FROM branches_fx GROUP BY job_id", "branches_fx")
def h7_expected_units(spark, sf_dir):
    rows = bound(spark, sf_dir, "branches_fx")
    steps = spark.createDataFrame([(s.name,) for s in diamond()], "step string")
    expected = fanout.expected_units(rows.groupBy("job_id").agg(F.count("*").alias("branches")), steps)
    done = rows.filter("x < 48").select("job_id", F.concat(F.lit("square:"), F.col("branch_idx").cast("string")).alias("unit")).union(rows.select("job_id", F.lit("scatter")))
    return fanout.unit_progress(expected, done)


_ID = "lpad(CAST(p_partkey AS VARCHAR), 14, '0') || '-' || replace(lower(p_type), ' ', '-') || '-1.' || p_size"


@query(f"SELECT {_ID} AS job_id, substr({_ID}, 1, 12) || substr({_ID}, 15) AS short, replace(lower(p_type), ' ', '-') AS stage FROM part")
def e16_e17_ids(spark, sf_dir):
    id_ = F.concat(F.lpad(F.col("p_partkey").cast("string"), 14, "0"), F.lit("-"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("-")), F.lit("-1."), F.col("p_size").cast("string"))
    return read(spark, sf_dir, "part").select(id_.alias("job_id")).select("job_id", short_id(F.col("job_id")).alias("short"), stage_of(F.col("job_id")).alias("stage"))


_AXES = {"quantity": range(1, 51), "mode": ["fast", "slow"], "flag": ["A"]}


@query("""WITH g AS (SELECT (m.o * 50 + q.v - 1) * 2 + z.o AS combo_id, m.v AS mode, q.v::INT AS quantity, z.flag, z.min FROM (VALUES (0, 'fast'), (1, 'slow')) AS m(o, v), range(1, 51) AS q(v), (VALUES (0, 'A', 0.02), (1, 'R', 0.05)) AS z(o, flag, min))
SELECT combo_id, mode, quantity, flag, count(l_orderkey) AS lines FROM g LEFT JOIN lineitem ON l_quantity = quantity AND l_returnflag = flag AND l_discount >= min GROUP BY ALL""")
def b4_build_axes(spark, sf_dir):
    axes = grid.build_axes(_AXES, [grid.axis_zip(flag=["A", "R"], min=[0.02, 0.05])])
    combos = grid.expand_grid(spark, axes)
    lines = read(spark, sf_dir, "lineitem").join(small(combos), (F.col("l_quantity") == F.col("quantity")) & (F.col("l_returnflag") == F.col("flag")) & (F.col("l_discount") >= F.col("min")))
    counts = lines.groupBy("combo_id").agg(F.count("*").alias("lines"))
    return combos.join(counts, "combo_id", "left").select("combo_id", "mode", F.col("quantity").cast("int").alias("quantity"), "flag", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("SELECT p_brand, 100 * count(DISTINCT p_type) AS size FROM part GROUP BY 1")
def b7_grid_size(spark, sf_dir):
    listed = grid.grid_size(grid.build_axes({k: v for k, v in _AXES.items() if k != "flag"}))
    return read(spark, sf_dir, "part").groupBy("p_brand").agg((F.countDistinct("p_type") * listed).alias("size"))


@query("SELECT stage, param FROM (SELECT DISTINCT p_brand AS stage, p_type || p_size AS param FROM part) WHERE param NOT IN (SELECT p_type || p_size FROM part WHERE p_retailprice > 1500)")
def b8_missing_params(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("stage"), F.concat("p_type", F.col("p_size").cast("string")).alias("param"), "p_retailprice")
    return grid.missing_params(rows.select("stage", "param").distinct(), rows.filter("p_retailprice > 1500"))


_CODED = "c0ffee"
_PARTS_ID = "x00".join(["s1", "a1", "b1", "g1"])


@query(f"""WITH g AS (SELECT p_partkey AS combo_id, p_brand AS brand FROM part),
k1 AS (SELECT *, {key_sql(_CODED, "'{\"brand\":\"' || brand || '\"}'", [], 'load')} AS key_load FROM g)
SELECT combo_id, key_load, {key_sql(_PARTS_ID, "'{}'", ['key_load'], 'fan')} AS key_fan FROM k1""")
def c3_identity_mode(spark, sf_dir):
    fan = Stage("fan", deps=("load",), parts={"gather": "g1", "b": "b1", "scatter": "s1", "a": "a1"})
    return identity.propagate_keys(_parts(spark, sf_dir), [Stage("load", params={"brand": "none"}, code=_CODED), fan]).select("combo_id", "key_load", "key_fan")
