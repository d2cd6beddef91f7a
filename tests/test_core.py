"""The library's operators on small golden cases."""

import json

import pytest
from pyspark.sql import functions as F

from gridweave.functions.ids import base32, content_id, glob_to_regex, mem_to_bytes, root_hash, short_id, stage_of
from gridweave.operators import fanout, grid, identity, lineage, lookup, retention, rules, status, sweep, wiring
from gridweave.operators.identity import Stage
from gridweave.operators.sweep import SweepStage
from gridweave.sources import catalog, completions, files


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_grid_slices_equal_the_grid(spark):
    axes = grid.build_axes({"b": [1, 2, 3], "a": ["x", "y"], "z1": [0]}, [grid.axis_zip(z1=[7, 8], z2=["p", "q"])])
    assert [a.names for a in axes] == [("a",), ("b",), ("z1", "z2")] and grid.grid_size(axes) == 12
    full = rows(grid.expand_grid(spark, axes))
    assert len(full) == 12 and full[0] == (0, "x", 1, 7, "p") and full[1] == (1, "x", 1, 8, "q")
    assert {r for r in full if r[0] >= 3} == set(rows(grid.grid_slice(spark, axes, 3, 99)))
    assert grid.expand_grid(spark, []).count() == 1 and grid.expand_grid(spark, [grid.axis_list("a", [])]).count() == 0
    with pytest.raises(grid.GridError, match="a has 2.*b has 1"):
        grid.axis_zip(a=[1, 2], b=[1])


def test_grid_problems_are_named(spark):
    found = grid.validate_grid({"a": 5, "b": [], "c": [[1]], "d": [1]}, {"z": ["d", "e"], "e": ["e"]}, ["q", "d"])
    assert len(found) == 7, found
    declared = spark.createDataFrame([("s", "a"), ("s", "b")], "stage string, param string")
    assert rows(grid.missing_params(declared, spark.createDataFrame([("a",)], "param string"))) == [("s", "b")]


def test_known_digests(spark):
    got = spark.range(1).select(base32(F.sha2(F.lit(""), 256)).alias("a"), content_id(F.lit("hello"), F.lit("world")).alias("b"), base32(F.sha2(F.lit("hellox00world"), 256), 32).alias("c")).first()
    assert got.a == "0mdqa9w1p6cmli6976v4wi0sw9r4p5prkj7lzfd1877wk11c9c73" and got.b == got.c and len(got.b) == 32


def test_id_helpers(spark):
    df = spark.createDataFrame([("0123456789abcdef-st-1.0", "4g", "2024-01-01_00-00-00_abc"), ("short-a-b-2", "x", "pin-lab-metadata.json")], "i string, m string, n string")
    got = df.select(short_id(F.col("i")), stage_of(F.col("i")), mem_to_bytes(F.col("m")), root_hash(F.col("n"), F.lit("auto")), root_hash(F.col("n"), F.lit("pinned"))).collect()
    assert tuple(got[0]) == ("0123456789ab-st-1.0", "st", 4 * 2**30, "abc", "2024-01-01_00-00-00_abc")
    assert tuple(got[1])[:3] == ("short-a-b-2", "a-b", None) and got[1][4] == "pin"
    assert [r[0] for r in spark.createDataFrame([("a.b*", "a.bcd"), ("a?c", "abbc")], "g string, s string").select(F.rlike("s", glob_to_regex(F.col("g")))).collect()] == [True, False]


#: The sweep of 64 combinations over seven stages.
def test_golden_sweep(spark):
    axes = grid.build_axes({"offset": [1, 2], "mode": ["fast", "slow"], "template_dir": ["t1", "t2"], "config_file": ["c1", "c2"], "workload_args": ["10 20 30", "5 15 25"], "env": ["e"], "nix_tool_bin": ["n"]}, [grid.axis_zip(multiplier=[2, 3], scale=[10, 100])])

    def a(_, p):
        return p.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("job_key", F.col("ord").cast("long").alias("ord"), (F.col("ord") + 1 + F.col("offset")).cast("long").alias("x"))

    def b(_, p):
        return p.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("job_key", F.col("ord").cast("long").alias("ord"), (F.col("ord") + 6).cast("long").alias("x"))

    steps = [fanout.Step("sq", value=F.col("x") * F.col("x")), fanout.Step("dbl", value=F.col("x") * 2), fanout.Step("out", ("sq", "dbl"), F.col("sq") + F.col("dbl"))]

    def d(inputs, _):
        return fanout.run_steps(inputs["C"].select(F.col("job_key").alias("job_id"), F.col("ord").alias("branch_idx"), "x"), steps).select(F.col("job_id").alias("job_key"), F.col("out").alias("value"))

    stages = [
        SweepStage(Stage("A", params={"offset": 0, "template_dir": "", "nix_tool_bin": ""}), a),
        SweepStage(Stage("B", params={"mode": "", "config_file": ""}), b),
        SweepStage(Stage("C", deps=("A", "B")), lambda i, p: sweep.stage_concat(i["A"], i["B"])),
        SweepStage(Stage("D", deps=("C",)), d),
        SweepStage(Stage("E", deps=("D",)), lambda i, p: sweep.stage_sum(i["D"], "value")),
        SweepStage(Stage("F", params={"mode": "", "multiplier": 1}, deps=("E",)), lambda i, p: sweep.stage_scale(p, i["E"].withColumnRenamed("total", "value"), "multiplier")),
        SweepStage(Stage("G", params={"workload_args": "", "offset": 0, "env": ""}, deps=("F",)), lambda i, p: p.join(i["F"], "job_key").select("job_key", (sweep.list_arg_reduce(F.col("workload_args"), F.col("offset")) + F.col("scaled")).alias("value"))),
    ]
    done = sweep.run_sweep(grid.expand_grid(spark, axes), stages)
    report = {r.stage: (r.total, r.unique) for r in identity.dedup_report(done.keyed, [s.stage for s in stages]).collect()}
    assert {k: v[1] for k, v in report.items()} == {"A": 4, "B": 4, "C": 16, "D": 16, "E": 16, "F": 32, "G": 64}
    assert {r.total for r in done.results["E"].collect()} == {540, 595}
    got = {(r.offset, r.multiplier, r.workload_args): r.value for r in done.table("G", ["offset", "multiplier", "workload_args"]).collect()}
    assert got[1, 2, "10 20 30"] == 1143 and got[1, 2, "5 15 25"] == 1128
    again = sweep.run_sweep(grid.expand_grid(spark, axes), stages[:1], {"A": done.results["A"]})
    assert again.results["A"].count() == done.results["A"].count()


def test_python_steps_and_failing_branches(spark):
    jobs = spark.createDataFrame([("a", [1, 2, 0, None]), ("b", []), ("c", None), ("d", [5])], "job_id string, items array<long>")
    reads = spark.createDataFrame([("a", 0, "x"), ("a", 0, "y"), ("d", 0, None), (None, 0, "z")], "job_id string, branch_idx int, word string")
    steps = (
        fanout.Step("inv", code=lambda b: 10 // b["item"], returns="long"),
        fanout.Step("words", code=lambda b: sorted(str(r["word"]) for r in b["rows"]), returns="array<string>", reads=reads),
        fanout.Step("twice", rows=lambda df: df.select("job_id", "branch_idx", (F.col("inv") * 2).alias("twice"))),
        fanout.Step("out", ("inv", "words", "twice"), code=lambda b: f"{b['inv']}{b['words']}{b['twice']}{sorted(b)}"),
    )
    got = {(r.job_id, r.branch_idx): r for r in fanout.run_steps(fanout.scatter(jobs, "items"), steps).collect()}
    cols = "['branch_idx', 'inv', 'item', 'job_id', 'twice', 'words']"
    assert got["a", 0].out == f"10['x', 'y']20{cols}" and got["a", 1].out == f"5[]10{cols}" and got["d", 0].out == f"2['None']4{cols}"
    assert got["a", 2].inv is None and got["a", 2].inv_error.startswith("ZeroDivisionError") and got["a", 2].out_error == "not run: inv failed"
    assert got["a", 3].inv_error.startswith("TypeError") and len(got) == 5
    wrong = fanout.run_steps(fanout.scatter(jobs, "items"), (fanout.Step("v", code=lambda b: "text" if b["item"] == 1 else 7, returns="long"),))
    assert {(r.branch_idx, r.v, r.v_error is None) for r in wrong.filter("job_id = 'a'").collect()} == {(0, None, False), (1, 7, True), (2, 7, True), (3, 7, True)}


def test_fan_out_gathers_complete_jobs_in_order(spark):
    jobs = spark.createDataFrame([("a", [3, 1, 2]), ("b", []), ("c", None), ("d", [5, 0]), ("e", [9])], "job_id string, items array<long>")
    steps = (fanout.Step("inv", code=lambda b: 60 // b["item"], returns="long"),)
    listed = lambda items: ",".join(f"{i}:{x}" for i, x in items)
    made = fanout.FanOut("items", steps, listed, "string").run(jobs)
    assert {(r.job_id, r.branches, r.done, r.first_missing, r.complete, r.gathered) for r in made.collect()} == {("a", 3, 3, None, True, "0:20,1:60,2:30"), ("b", 0, 0, None, True, ""), ("c", 0, 0, None, True, ""), ("d", 2, 1, 1, False, None), ("e", 1, 1, None, True, "0:6")}

    def bad(items):
        first = next(items)[1]
        if first == 6:
            raise KeyError("e")
        return str(first)

    got = {r.job_id: (r.gathered, r.error) for r in fanout.FanOut("items", steps, bad, "string").run(jobs).collect()}
    assert got["a"] == ("20", None) and got["e"] == (None, "KeyError: 'e'") and got["d"] == (None, None) and got["b"][1].startswith("StopIteration")


def test_a_long_job_streams_and_merges(spark):
    n = 300_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("job_id"), F.col("id").alias("branch_idx"), (F.col("id") % 1000).alias("x")).union(spark.createDataFrame([(2, 5, 7), (2, 3, 8), (None, 0, 4)], "job_id long, branch_idx long, x long")).repartition(5)

    def check(items):
        last, total = -1, 0
        for i, x in items:
            assert i > last
            last, total = i, total * 3 % 1_000_003 + x
        return total

    def part(items):
        items = list(items)
        return [check(iter(items)), len(items)]

    def join(states):
        total = 0
        for _, (t, k) in states:
            total = total * pow(3, k, 1_000_003) + t
        return total % 1_000_003

    want = {1: 0, 2: (8 * 3 + 7), None: 4}
    for i in range(n):
        want[1] = want[1] * 3 % 1_000_003 + i % 1000
    streamed = {r.job_id: r.gathered % 1_000_003 for r in fanout.gather_stream(rows, "x", check, "long").collect()}
    assert streamed == {k: v % 1_000_003 for k, v in want.items()}
    merged = {r.job_id: r.gathered for r in fanout.gather_merge(rows, "x", part, "array<long>", join, "long", piece=70_000).collect()}
    assert merged == {k: v % 1_000_003 for k, v in want.items()}
    empty = rows.filter("false")
    assert fanout.gather_stream(empty, "x", check, "long").count() == 0


def test_threshold_sweeps_equal_plain_selections(spark):
    import random

    r = random.Random(5)
    data = [(r.choice([None, *range(8)]), r.choice([0.5, 1.0, 2.5, None]), r.choice("xyz"), r.randrange(100)) for _ in range(400)]
    df = spark.createDataFrame(data, "a int, b double, c string, v long")
    axes = [sweep.Threshold("lo", "a", ">=", (6, 2, 2, 9)), sweep.Threshold("hi", "b", "<=", (0.1, 1.0, 2.0)), sweep.Threshold("is", "c", "=", ("x", "q")), sweep.Threshold("top", "a", "<=", (3, 7))]
    got = {tuple(x)[:4]: tuple(x)[4:] for x in sweep.threshold_sweep(df, axes, {"total": F.col("v"), "most": F.col("v") * 2}).collect()}
    assert len(got) == 3 * 3 * 2 * 2
    for (lo, hi, c, top), (n, total, double) in got.items():
        hit = [v for a, b, k, v in data if a is not None and b is not None and lo <= a <= top and b <= hi and k == c]
        assert (n, total, double) == (len(hit), sum(hit), 2 * sum(hit))
    assert {x.n for x in sweep.threshold_sweep(df.filter("false"), axes[:1], {}).collect()} == {0}
    many = [sweep.Threshold("a", "a", "<=", tuple(range(100))), sweep.Threshold("v", "v", ">=", tuple(range(100)))]
    assert sweep.threshold_sweep(df, many, {"total": F.col("v")}).count() == 10_000


def test_a_new_version_invalidates_what_follows(spark):
    g = grid.expand_grid(spark, [grid.axis_list("p", [1, 2])])
    old = identity.propagate_keys(g, [Stage("a", params={"p": 0}), Stage("b", deps=("a",))])
    new = identity.propagate_keys(g, [Stage("a", "2.0", {"p": 0}), Stage("b", deps=("a",))])
    assert old.join(new, "key_b").count() == 0 and old.repartition(3).join(old.select("key_a"), "key_a").count() == 2
    digest = identity.run_digest(old, "key_b", block=2)
    linked = identity.propagate_keys(g, [Stage("c")], {"c": digest})
    assert linked.select("key_c").distinct().count() == 1


def test_trees_of_keys_find_what_changed(spark):
    old = spark.range(5000).select(F.col("id").alias("combo_id"), F.concat(F.lit("k"), "id").alias("key"))
    new = old.filter("combo_id <> 77").withColumn("key", F.when(F.col("combo_id").isin(3, 4000), "x").otherwise(F.col("key"))).union(spark.createDataFrame([(9000, "more")], "combo_id long, key string"))
    for block in (7, 4096):
        roots = [identity.run_digest(df.repartition(5), "key", block=block).first()[0] for df in (old, old, new)]
        assert roots[0] == roots[1] != roots[2]
        assert rows(identity.changed_keys(old, new, "key", block=block)) == [(3, "k3", "x"), (4000, "k4000", "x"), (77, "k77", None), (9000, None, "more")]
        assert identity.changed_keys(old, old, "key", block=block).count() == 0
    assert identity.run_digest(old.filter("false"), "key").first()[0] is None
    with pytest.raises(ValueError, match="two children"):
        identity.key_tree(old, "key", block=1)


EDGES = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "x")]


def graph(spark, edges=EDGES):
    return spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], "job_id string, dep_id string, pos int")


def nodes(spark, ids="abcde"):
    return spark.createDataFrame([(i, "r") for i in ids], "job_id string, run string")


def test_levels_cycles_and_unknown(spark):
    done, left, unknown = lineage.levels(nodes(spark), graph(spark), unknown="ignore")
    assert rows(done) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 0)] and left.count() == 0 and rows(unknown) == [("e", "x")]
    done, left, unknown = lineage.levels(nodes(spark), graph(spark))  # what needs something unknown never runs
    assert rows(done) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)] and rows(left) == [("e",)] and rows(unknown) == [("e", "x")]
    with pytest.raises(ValueError, match="'e'"):
        lineage.topo_order(nodes(spark), graph(spark))
    order = {r.job_id: r.ord for r in lineage.topo_order(nodes(spark, "abcd"), graph(spark, EDGES[:4])).collect()}
    assert order == {"a": 0, "b": 1, "c": 2, "d": 3}
    with pytest.raises(ValueError, match="cycle"):
        lineage.topo_order(nodes(spark, "ab"), graph(spark, [("a", "b"), ("b", "a")]))


def test_closure_and_tree(spark):
    seeds = nodes(spark, "d")
    assert rows(lineage.ancestors(graph(spark), seeds)) == [("a", 2), ("b", 1), ("c", 1), ("d", 0)]
    assert [r.job_id for r in lineage.descendants(graph(spark), nodes(spark, "a")).orderBy("job_id").collect()] == list("abcd")
    assert [tuple(r)[1:] for r in lineage.dep_tree(graph(spark), "d").orderBy("ord").collect()] == [("d", 0, False), ("b", 1, False), ("a", 2, False), ("c", 1, False), ("a", 2, True)]


def test_deep_trees_are_whole(spark):
    """Diamonds one below the other: many paths, each node expanded once."""
    edges = [e for i in range(12) for e in ((f"n{i}", f"a{i}"), (f"n{i}", f"b{i}"), (f"a{i}", f"n{i + 1}"), (f"b{i}", f"n{i + 1}"))]
    got = lineage.dep_tree(graph(spark, edges), "n0").orderBy("ord").collect()
    want, seen = [], set()

    def visit(node, depth):
        want.append((node, depth, node in seen))
        if node not in seen:
            seen.add(node)
            for d in sorted(d for j, d in edges if j == node):
                visit(d, depth + 1)

    visit("n0", 0)
    assert [(r.job_id, r.depth, r.seen) for r in got] == want
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(3)]
    assert lineage.dep_tree(graph(spark, [*chain, ("c002", "c000")]), "c000").count() == 5


def test_inherited_attributes(spark):
    own = spark.createDataFrame([("a", "k", "1"), ("b", "k", "2"), ("c", "m", "3"), ("d", "m", None), ("c", "k", None)], "job_id string, k string, v string")
    got = {(r.job_id, r.k): r.v for r in lineage.inherit_attributes(nodes(spark), graph(spark), own).collect()}
    assert got == {("a", "k"): "1", ("b", "k"): "2", ("c", "k"): None, ("c", "m"): "3", ("d", "k"): None, ("d", "m"): None}
    by_id = {(r.job_id, r.k): r.v for r in lineage.inherit_attributes(nodes(spark), graph(spark).withColumn("pos", -F.col("pos")), own).collect()}
    assert by_id["d", "k"] == "2"


def test_status_of_a_diamond(spark):
    log = spark.createDataFrame([(1, "a", "fail"), (2, "a", "ok"), (3, "b", "fail")], "seq long, job_id string, s string")
    known = status.latest_outcome(log)
    assert rows(known) == [("a", "Succeeded"), ("b", "Failed")]
    got = {r.job_id: (r.status, r.missing_deps) for r in status.derive_status(nodes(spark), graph(spark), known).collect()}
    assert got["c"] == ("Pending", None) and got["d"] == ("Blocked", ["b", "c"]) and got["e"] == ("Blocked", ["x"])
    assert rows(status.failure_impact(nodes(spark), graph(spark), known)) == [("a", "succeeded"), ("b", "failed"), ("d", "skipped")]
    assert rows(status.ready(status.todo(graph(spark), nodes(spark, "d"), known), graph(spark))) == [("b",), ("c",)]


def test_fanout_checks(spark):
    with pytest.raises(fanout.FanOutError, match="cycle"):
        fanout.step_order([fanout.Step("a", ("b",)), fanout.Step("b", ("a",))])
    found = wiring.check_fanout([fanout.Step("a"), fanout.Step("b")], ["work__items"], [], {"a": ["x"]}, ["o", "p"])
    assert len(found) == 5, found
    assert fanout.scatter(spark.createDataFrame([(1, [5, 6]), (2, [])], "job_id long, items array<long>"), "items").count() == 2


def test_wiring(spark):
    outs = spark.createDataFrame([("p", "x"), ("p", "y")], "stage string, name string")
    ins = spark.createDataFrame([("c", "x"), ("c", "z")], "stage string, name string")
    m = spark.createDataFrame([("c", "p", "x", None), ("c", "p", "y", "z"), ("c", "p", "q", "z"), ("c", "p", "x", "w")], "stage string, dep string, source string, target string")
    good, bad = wiring.wire_explicit(m, outs, ins)
    assert good.count() == 2 and {r.problem for r in bad.collect()} == {"no such output", "no such input"}
    assert rows(wiring.check_disjoint(good.union(good))) == [("c", "x", 2), ("c", "z", 2)]
    runs = spark.createDataFrame([("a",), ("b",), ("b",)], "run string")
    deps = spark.createDataFrame([("a", "b", None), ("b", "a", "soft"), ("a", "zz", None)], "run string, dep_run string, dep_type string")
    _, problems = wiring.run_graph(runs, deps, spark.createDataFrame([("a", "b")], "group string, run string"))
    assert {r.what for r in problems.collect()} == {"duplicate run", "group named like a run", "in or behind a cycle", "unknown run"}


def test_lookups(spark):
    df = spark.createDataFrame([("12345-a-1.0", "a", "r1", {"k": "v"}), ("12-b-1.0", "b", "r2", {})], "job_id string, name string, run string, eff map<string,string>")
    with pytest.warns(UserWarning, match="unknown operator"):
        assert lookup.where(df, name__near="a").count() == 1
    assert lookup.where(df, param_k="v").count() == 1 and lookup.search(df, "%params k=v").count() == 1
    got = {r.prefix: r.result for r in lookup.lookup(df, spark.createDataFrame([("12",), ("123",), ("9",)], "prefix string")).collect()}
    assert got == {"12": "ambiguous", "123": "match", "9": "not found"}
    ids = [("12",), ("123",), ("9",), ("12345-a-1.0",), (None,)]
    for k in (0, 3, 5):
        got = {r.prefix: (r.result, r.n) for r in lookup.lookup(df, spark.createDataFrame(ids, "prefix string"), k).collect()}
        assert got == {"12": ("ambiguous", 2), "123": ("match", 1), "9": ("not found", 0), "12345-a-1.0": ("match", 1), None: ("not found", 0)}, k
    eff = spark.createDataFrame([("j", "a", '{"b": {"c": 1}, "d": "x"}'), ("j", "e", "{no json"), ("k", "a", "7")], "job_id string, k string, v string")
    jobs = spark.createDataFrame([("j", "n"), ("k", "n")], "job_id string, name string")
    wide = lookup.to_table(jobs, eff)
    assert wide.columns == ["job_id", "name", "a", "a.b.c", "a.d", "e"] and rows(wide) == [("j", "n", None, "1", "x", "{no json"), ("k", "n", "7", None, None, None)]
    with pytest.raises(KeyError, match="no run"):
        lookup.run_of(jobs, spark.createDataFrame([("j", "r", 1)], "job_id string, run string, ord int"), missing="error")
    with pytest.raises(ValueError, match="unknown or empty"):
        lookup.select_runs(df, spark.createDataFrame([("g", None)], "group string, run string"), "@g")


def test_retention(spark):
    roots = spark.createDataFrame([(f"2024-01-0{i}", "auto", "p", str(i)) for i in range(1, 8)] + [("pin", "pinned", "p", "1")], "name string, kind string, project string, target string")
    kept = retention.keep_last_n(roots)
    assert kept.count() == 6
    new = spark.createDataFrame([("pin", "2", "p"), ("bad", "99", "p")], "name string, target string, project string")
    after, missing = retention.pin(roots, new, roots.select("target"))
    assert after.filter("name = 'pin'").first().target == "2" and missing.count() == 1
    left, unknown = retention.unpin(roots, spark.createDataFrame([("pin",), ("no",)], "name string"))
    assert left.count() == 7 and unknown.count() == 1


def test_worker_rules(spark):
    jobs = spark.createDataFrame([(1, "sum-a", "t", None, 2), (2, "map-a", "u", "9G", None)], "id int, name string, tgt string, mem string, worker_cpus int")
    table = spark.createDataFrame([(0, None, None, "1G", 1, None), (1, "sum*", "t", None, 4, ("2G", None)), (2, "*-a", None, None, None, (None, 8))], "ord int, glob string, target string, mem string, cpus int, worker struct<mem:string,cpus:int>")
    assert rows(rules.resolve_rules(jobs, table, "id", "name", "tgt", ["mem", "cpus"])) == [(1, "1G", 4), (2, "1G", 1)]
    assert rows(rules.resolve_worker_rules(jobs, table, "id", "name", "tgt", ["mem", "cpus"])) == [(1, "1G", 8), (2, "1G", 8)]


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_run_files_of_one_name_stay_apart(spark, tmp_path):
    job = {"name": "n", "stage_type": "simple", "executables": {}}
    write(tmp_path / "a.json", json.dumps({"name": "ra", "type": "run", "jobs": {"j1": job, "j2": job}}))
    write(tmp_path / "sub/a.json", json.dumps({"name": "rb", "type": "run", "jobs": {"j2": job}}))
    write(tmp_path / "sub/x+y z%20é/a.json", json.dumps({"name": "rc", "type": "run", "jobs": {"j3": job}}))
    write(tmp_path / "root.json", json.dumps({"runs": ["sub/a.json", "a.json", "sub/x+y z%20é/a.json", "gone/a.json"], "groups": {}}))
    for folder in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
        c = catalog.read_catalog(spark, folder)
        assert rows(c.runs.select("run")) == [("ra",), ("rb",), ("rc",)]
        assert rows(c.run_jobs) == [("ra", "j1", 1), ("ra", "j2", 1), ("rb", "j2", 0), ("rc", "j3", 2)]
        assert {(r.job_id, r.run) for r in lookup.run_of(c.run_jobs.select("job_id").distinct(), c.run_jobs).collect()} == {("j1", "ra"), ("j2", "ra"), ("j3", "rc")}
    write(tmp_path / "root.json", json.dumps({"runs": [], "groups": {}}))
    assert catalog.read_catalog(spark, str(tmp_path)).jobs.count() == 0


def test_results_do_not_depend_on_the_number_of_jobs(spark, tmp_path, monkeypatch):
    n = 1500
    for i in range(n):
        if i % 10:
            write(tmp_path / f"j{i}/out/d.csv", "x,y\n" + "".join(f"{k},v{i}\n" for k in range(i % 3)))
    jobs = spark.createDataFrame([(f"j{i}", "simple") for i in range(n)], "job_id string, stage_type string")
    outputs = spark.createDataFrame([(f"j{i}", "main", "data", "$out/d.csv") for i in range(n)], "job_id string, exe string, output string, template string")
    for some in (jobs, jobs.filter("job_id in ('j10', 'j11', 'j14')")):
        ids = {int(r.job_id[1:]) for r in some.collect()}
        for schema in ("x int, y string", None):
            got, missing = catalog.load_results(some, outputs, "data", str(tmp_path), schema=schema)
            assert {r.job_id for r in missing.collect()} == {f"j{i}" for i in ids if i % 10 == 0}
            cells = {(r.job_id, r.x, r.y) if schema else (r.job_id, int(r.row["x"]), r.row["y"]) for r in got.collect()}
            assert cells == {(f"j{i}", k, f"v{i}") for i in ids if i % 10 for k in range(i % 3)}


def test_large_and_odd_files_are_read_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "SPLIT_BYTES", 100)
    lines = [f"{i}" * (i % 40) for i in range(300)]
    write(tmp_path / "big/out/r.txt", "\n".join(lines))
    write(tmp_path / "dir/out/r.txt/part-1", "b\r\nc\n")
    write(tmp_path / "dir/out/r.txt/part-0", "a\n")
    write(tmp_path / "dir/out/r.txt/_SUCCESS", "")
    write(tmp_path / "none/out/r.txt", "")
    write(tmp_path / "q/out/r.csv", 'k,"a ""b"", c",d\n1,"x, y",\n2,z,"q"\n')
    write(tmp_path / "q/out/r.json", '{"a": 1}\n\n{"b": "x"}\n')
    jobs = spark.createDataFrame([(j, "simple") for j in ("big", "dir", "none", "gone", None)], "job_id string, stage_type string")
    nothing = spark.createDataFrame([], "job_id string, exe string, output string, template string")
    got, missing = catalog.load_results(jobs, nothing, "r.txt", str(tmp_path), format="text")
    assert sorted(r.value for r in got.filter("job_id = 'big'").collect()) == sorted(lines)
    assert rows(got.filter("job_id <> 'big'")) == [("dir", "a"), ("dir", "b"), ("dir", "c")] and {r.job_id for r in missing.collect()} == {"gone"}
    one = spark.createDataFrame([("q", "simple")], "job_id string, stage_type string")
    assert sorted((r.row for r in catalog.load_results(one, nothing, "r.csv", str(tmp_path))[0].collect()), key=str) == sorted([{"k": "1", 'a "b", c': "x, y", "d": ""}, {"k": "2", 'a "b", c': "z", "d": "q"}], key=str)
    assert rows(catalog.load_results(one, nothing, "r.json", str(tmp_path), format="json", schema="a int, b string")[0]) == [("q", 1, None), ("q", None, "x")]


def test_catalog_and_results(spark, tmp_path):
    job = lambda name, p, deps=(): {"name": name, "stage_type": "simple", "params": p, "executables": {"main": {"path": "x", "inputs": [{"job_id": d, "target_input": "i"} for d in deps], "outputs": {"data": "$out/d.csv"}}}}
    write(tmp_path / "runs/r1.json", json.dumps({"name": "r1", "type": "run", "dependencies": {}, "jobs": {"j1": job("a", {"n": "1"}), "j2": job("b", {}, ["j1"])}}))
    write(tmp_path / "runs/r2.json", json.dumps({"type": "run", "dependencies": {"r1": "soft"}, "jobs": {"j2": job("b2", {"n": "2"}, ["j1"])}}))
    write(tmp_path / "root.json", json.dumps({"runs": ["runs/r1.json", "runs/r2.json", "runs/gone.json"], "groups": {"all": ["r1"], "none": []}}))
    c = catalog.read_catalog(spark, str(tmp_path))
    assert {(r.job_id, r.name) for r in c.jobs.collect()} == {("j1", "a"), ("j2", "b2")} and c.edges.filter("dep_id = 'j1'").count() == 1
    assert {(r.group, r.run) for r in c.groups.collect()} == {("all", "r1"), ("none", None)} and {r.run for r in c.runs.collect()} == {"r1", "unknown_run"}
    with pytest.raises(FileNotFoundError):
        catalog.read_catalog(spark, str(tmp_path), on_missing="error")
    for j in ("j1", "j2"):
        write(tmp_path / f"out/{j}/out/d.csv", f"x,y\n1,{j}\n2,{j}\n")
    eff = lineage.inherit_attributes(c.jobs, c.edges, c.jobs.select("job_id", F.explode("params").alias("k", "v")))
    got, missing = catalog.load_results(c.jobs, c.outputs, "data", str(tmp_path / "out"), eff)
    assert {(r.job_id, r.row["y"], r.params["n"]) for r in got.collect()} == {("j1", "j1", "1"), ("j2", "j2", "2")} and got.count() == 4
    assert missing.count() == 0 and catalog.load_results(c.jobs, c.outputs, "d.csv", str(tmp_path / "out"), schema="x int, y string")[0].count() == 4
    catalog.write_catalog(c.jobs.union(c.jobs), str(tmp_path / "written"))
    assert spark.read.parquet(str(tmp_path / "written/jobs")).count() == 2
    catalog.write_catalog(c.jobs, str(tmp_path / "written2"), spark.createDataFrame([("r1", "unknown_run", None)], "run string, dep_run string, dep_type string").filter("false"))
    with pytest.raises(ValueError, match="unknown"):
        catalog.write_catalog(c.jobs, str(tmp_path / "written3"), spark.createDataFrame([("r1", "zz", None)], "run string, dep_run string, dep_type string"))
    with pytest.raises(KeyError, match="its keys: .'data'"):
        catalog.output_paths(c.jobs, c.outputs, "nothing", "/x")
    moved = spark.createDataFrame([("j1", "/m/1/"), ("j2", "/m/2")], "job_id string, dir string")
    assert rows(catalog.output_paths(c.jobs, c.outputs, "data", moved)) == [("j1", "/m/1/d.csv"), ("j2", "/m/2/d.csv")]
    with pytest.raises(FileNotFoundError, match="j2"):
        catalog.output_paths(c.jobs, c.outputs, "data", moved.limit(1))
    assert catalog.read_run(spark, str(tmp_path / "runs/r1.json")).jobs.count() == 2
    with pytest.raises(ValueError, match="no run"):
        catalog.read_run(spark, str(tmp_path / "root.json"))
    listed = files.list_outputs(spark, c.jobs.select("job_id").union(spark.sql("SELECT 'j9'")), str(tmp_path / "out"))
    assert {(r.job_id, r.file, r.state) for r in listed.collect()} == {("j1", "out/d.csv", "executed"), ("j2", "out/d.csv", "executed"), ("j9", None, "not executed")}
    assert [r.path.rsplit("/", 1)[1] for r in files.scan_paths(spark, str(tmp_path), "directory", "r.*").collect()] == ["runs"]
    (tmp_path / "odd (1)+/empty").mkdir(parents=True)
    write(tmp_path / "odd (1)+/f.txt", "x")
    assert [(r.path.rsplit("/", 1)[1], r.kind) for r in files.scan_paths(spark, str(tmp_path / "odd (1)+")).collect()] == [("empty", "directory"), ("f.txt", "file")]
    assert rows(files.hashed_files(spark, str(tmp_path / "odd (1)+")).select("path")) == [("f.txt",)]


def test_completion_logs(spark, tmp_path):
    assert completions.read_completions(spark, str(tmp_path / "none")) is None
    log = tmp_path / "log.jsonl"
    log.write_text('{"id": "a", "s": "fail"}\n\nbroken\n{"id": "a", "s": "ok"}\n{"id": "b", "s": "?"}\n')
    good, bad = completions.read_completions(spark, str(log))
    assert rows(status.latest_outcome(good)) == [("a", "Succeeded")] and bad.count() == 2
    for p in ("a/marks/SUCCESS", "a/marks/FAIL", "b/marks/FAIL"):
        write(tmp_path / "o" / p, "")
    assert rows(completions.scan_markers(spark, str(tmp_path / "o"))) == [("a", "Succeeded"), ("b", "Failed")]
    completions.append_completions(good, str(tmp_path / "again"))
    assert completions.read_completions(spark, str(tmp_path / "again"))[0].count() == 2
    outcome = lambda *r: spark.createDataFrame(r, "job_id string, s string").coalesce(1)
    path = str(tmp_path / "a (log)+")
    completions.append_completions(outcome(("a", "fail")), path)
    completions.append_completions(outcome(("a", "ok"), *((f"j{i}", "ok") for i in range(500))), path)
    assert rows(status.latest_outcome(completions.read_completions(spark, path)[0]).filter("job_id = 'a'")) == [("a", "Succeeded")]
    completions.append_completions(outcome(("a", "fail")), path)
    assert rows(status.latest_outcome(completions.read_completions(spark, path)[0]).filter("job_id = 'a'")) == [("a", "Failed")]


def test_two_writers_of_one_log(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "log of two")
    frame = lambda w, i: spark.createDataFrame([("shared", "ok" if w else "fail"), (f"{w}-{i}", "ok")], "job_id string, s string")
    with ThreadPoolExecutor(2) as pool:
        places = [list(x) for x in pool.map(lambda w: [completions.append_completions(frame(w, i), path) for i in range(8)], (0, 1))]
    assert sorted(sum(places, [])) == list(range(1, 17)) and all(p == sorted(p) for p in places)
    good, bad = completions.read_completions(spark, path)
    assert good.count() == 32 and bad.count() == 0 and good.select("seq").distinct().count() == 32
    last = max((n, w) for w, p in enumerate(places) for n in p)[1]
    assert rows(status.latest_outcome(good).filter("job_id = 'shared'")) == [("shared", "Succeeded" if last else "Failed")]
    frame(0, 99).write.json(f"{path}/data-0123")  # an append that did not end
    write(tmp_path / "log of two/old.jsonl", '{"id": "shared", "s": "fail"}\n{"id": "old", "s": "ok"}\nbroken\n')
    good, bad = completions.read_completions(spark, path)
    assert good.count() == 34 and bad.count() == 1
    assert rows(status.latest_outcome(good).filter("job_id in ('shared', 'old')"))[1] == ("shared", "Succeeded" if last else "Failed")
    (tmp_path / "log of two/_last").unlink()  # a hint only
    assert completions.append_completions(frame(1, 9), path) == 17


def test_deep_graphs_take_few_rounds(spark):
    n = 300
    chain = spark.range(1, n).select(F.format_string("c%05d", "id").alias("job_id"), F.format_string("c%05d", F.col("id") - 1).alias("dep_id"), F.lit(0).alias("pos"))
    ids = spark.range(n).select(F.format_string("c%05d", "id").alias("job_id"))
    seed = spark.createDataFrame([(f"c{n - 1:05d}",)], "job_id string")
    up = lineage.ancestors(chain, seed)
    assert up.count() == n and up.filter(F.col("depth") != n - 1 - F.substring("job_id", 2, 5).cast("int")).count() == 0
    done, left, lost = lineage.levels(ids, chain)
    assert done.filter(F.col("level") != F.substring("job_id", 2, 5).cast("int")).count() == 0 and done.count() == n and left.count() == lost.count() == 0
    own = spark.createDataFrame([("c00000", "a", "low"), ("c00100", "a", None), ("c00200", "b", "x")], "job_id string, k string, v string")
    got = {(r.job_id, r.k): r.v for r in lineage.inherit_attributes(ids, chain, own).filter("job_id in ('c00099', 'c00150', 'c00299')").collect()}
    assert got == {("c00099", "a"): "low", ("c00150", "a"): None, ("c00299", "a"): None, ("c00299", "b"): "x"}
    ring = chain.union(spark.createDataFrame([("c00000", "c00099", 0)], "job_id string, dep_id string, pos int"))
    done, left, _ = lineage.levels(ids, ring)
    assert done.count() == 0 and left.count() == n
    assert lineage.ancestors(ring, seed).count() == n


def test_random_graphs_against_brute_force(spark):
    import random

    for seed in (0, 2):
        r = random.Random(seed)
        names = [f"n{i:02d}" for i in range(40)]
        edges = sorted({(names[i], names[j]) for i in range(1, 40) for j in r.sample(range(i), min(i, r.choice([0, 1, 1, 1, 2, 3])))} | {("n30", "gone"), ("n05", "self")})
        if seed == 2:
            edges += [("n10", "n20"), ("n20", "n10")]
        deps = {x: [d for j, d in edges if j == x and d != "self"] for x in names}
        known = {x: [d for d in deps[x] if d in deps] for x in names}
        for unknown, use in (("error", deps), ("ignore", known)):
            want = {}
            while more := {x: 1 + max((want[d] for d in use[x]), default=-1) for x in names if x not in want and all(d in want for d in use[x])}:
                want |= more
            done, left, lost = lineage.levels(nodes(spark, names), graph(spark, edges), unknown)
            assert {q.job_id: q.level for q in done.collect()} == want and {q.job_id for q in left.collect()} == set(names) - set(want)
            assert rows(lost) == [("n30", "gone")]
        own = {(x, k): r.choice([None, f"{x}{k}"]) for x in names for k in "ab" if r.random() < 0.3}
        table = spark.createDataFrame([(x, k, v) for (x, k), v in own.items()], "job_id string, k string, v string")
        if seed == 2:
            with pytest.raises(ValueError, match="cycle"):
                lineage.inherit_attributes(nodes(spark, names), graph(spark, edges), table)
            continue
        place = {e: i for i, e in enumerate(edges)}
        for order in ("position", "id"):
            eff = {}
            for x in names:  # names are in topological order
                eff[x] = {}
                for d in sorted(known[x], key=lambda d: place[x, d] if order == "position" else d):  # noqa: B023
                    eff[x] |= eff[d]
                eff[x] |= {k: v for (j, k), v in own.items() if j == x}
            got = lineage.inherit_attributes(nodes(spark, names), graph(spark, edges), table, order)
            assert {(q.job_id, q.k): q.v for q in got.collect()} == {(x, k): v for x in names for k, v in eff[x].items()}


def test_streams_equal_batches(spark, tmp_path):
    from gridweave.streaming.live import stream_completion_rate, stream_latest, stream_run_status

    for i, part in enumerate(([(1, "a", "fail"), (2, "b", "ok")], [(3, "a", "ok"), (1, "a", "fail")])):
        spark.createDataFrame(part, "seq long, job_id string, s string").coalesce(1).write.json(str(tmp_path / "in"), mode="append")
    log = spark.readStream.schema("seq long, job_id string, s string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stream_latest(log).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("latest")) == [("a", "Succeeded"), ("b", "Succeeded")]
    jobs = spark.createDataFrame([("r1", "a"), ("r2", "b"), ("r2", "c")], "run string, job_id string")
    name = f"live_{tmp_path.name.replace('-', '_')}"
    stream_run_status(log, jobs, str(tmp_path / "cp"), name).awaitTermination(120)
    assert rows(spark.table(name)) == [("r1", "Succeeded"), ("r2", "Blocked")]
    ev = spark.createDataFrame([("2024-01-01 00:10:00", 1), ("2024-01-01 00:20:00", 0), ("2024-01-01 05:00:00", 1)], "t string, ok int").select(F.col("t").cast("timestamp").alias("ts"), "ok")
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    q = stream_completion_rate(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")), "ts", F.col("ok") == 1, "1 hour", "1 minute").writeStream.outputMode("append").format("memory").queryName("rate").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.rate for r in spark.table("rate").collect()] == [1]


def test_live_run_states_equal_the_batch_after_every_batch(spark, tmp_path):
    from gridweave.streaming.live import stream_run_status

    jobs = spark.createDataFrame([("r1", "a"), ("r2", "b"), ("r2", "c"), ("r3", "a"), ("r3", "c"), ("r3", "c"), ("r4", "z")], "run string, job_id string")
    name = f"states_{tmp_path.name.replace('-', '_')}"
    sent = []
    for part in ([(5, "a", "fail"), (2, "b", "ok"), (1, "b", "fail")], [(3, "a", "ok"), (5, "a", "fail"), (6, "c", "ok")], [(7, "a", "ok"), (7, "a", "ok"), (9, "unknown", "ok")], [(1, "c", "fail")], [(10, "c", "fail"), (11, "c", "ok"), (12, "b", "fail")]):
        spark.createDataFrame(part, "seq long, job_id string, s string").repartition(2).write.json(str(tmp_path / "in"), mode="append")
        sent += part
        log = spark.readStream.schema("seq long, job_id string, s string").json(str(tmp_path / "in"))
        stream_run_status(log, jobs, str(tmp_path / "cp"), name).awaitTermination(120)
        known = status.latest_outcome(spark.createDataFrame(sent, "seq long, job_id string, s string"))
        runs = jobs.join(known, "job_id").select("run").distinct()
        assert rows(spark.table(name)) == rows(status.run_status(runs, jobs.join(runs, "run", "left_semi").join(known, "job_id", "left")))


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=100)
    assert said.returncode == 0 and int(said.stdout) >= 94, said.stderr


def test_fan_out_counts_its_branches_once(spark):
    """What is read after the steps are the kept rows: no aggregate over branches is left in the plan."""
    jobs = spark.createDataFrame([(1, [1, 2]), (2, [3])], "job_id long, items array<long>")
    made = fanout.FanOut("items", (fanout.Step("out", value=F.col("item") * 2),), lambda items: sum(x for _, x in items), "long").run(jobs)
    assert "Aggregate" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.job_id, r.branches, r.gathered) for r in made.collect()) == [(1, 2, 6), (2, 1, 6)]


def test_lists_and_values_of_coded_steps():
    import pyarrow as pa

    rows = pa.array([[{"a": 1, "b": [2]}], [], [{"a": None, "b": None}, {"a": 3, "b": []}]], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.list_(pa.int64()))])))
    assert fanout._listed(rows) == rows.to_pylist() and fanout._listed(rows.slice(1)) == rows.to_pylist()[1:]
    failed = [None, None, "ValueError: x"]
    assert fanout._values([1, "no", None], failed, pa.int64()).to_pylist() == [1, None, None]
    assert failed[0] is None and failed[1].startswith("Arrow") and failed[2] == "ValueError: x"
