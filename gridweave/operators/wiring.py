"""Derives edges from declared inputs and outputs, and reports what does not fit, as tables.

outputs: (stage, name). inputs: (stage, name). deps: (stage, dep).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.operators.fanout import Step, sink_of
from gridweave.operators.lineage import levels
from gridweave.shared import checkpoint, checkpoint_sliced, discard, shared_path, small


def wire_implicit(deps: DataFrame, outputs: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (stage, dep, name) where a dependency's output has an input's name; dependencies without any."""
    have = outputs.select(F.col("stage").alias("dep"), "name")
    edges = deps.join(have, "dep").join(inputs, ["stage", "name"]).select("stage", "dep", "name").distinct()
    return edges, deps.join(edges, ["stage", "dep"], "left_anti").select("stage", "dep").distinct()


def wire_explicit(mappings: DataFrame, outputs: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (stage, dep, source, target) of mappings whose ends exist (target defaults to source); problems (.., problem)."""
    m = mappings.withColumn("target", F.coalesce("target", "source"))
    out, into = outputs.select(F.col("stage").alias("dep"), F.col("name").alias("source")), inputs.select("stage", F.col("name").alias("target"))
    cols = ["stage", "dep", "source", "target"]
    no_source, no_target = m.join(out, ["dep", "source"], "left_anti").select(cols), m.join(into, ["stage", "target"], "left_anti").select(cols)
    bad = no_source.withColumn("problem", F.lit("no such output")).union(no_target.withColumn("problem", F.lit("no such input")))
    return m.join(out, ["dep", "source"], "left_semi").join(into, ["stage", "target"], "left_semi").select(cols), bad


def check_disjoint(edges: DataFrame) -> DataFrame:
    """(stage, target, n): inputs that more than one mapping fills."""
    return edges.groupBy("stage", "target").agg(F.count("*").alias("n")).filter("n > 1")


def wire_inter_run(stages: DataFrame, deps: DataFrame, inputs: DataFrame, run_deps: DataFrame, reserved: Sequence[str] = ("run__metadata", "store__base")) -> tuple[DataFrame, DataFrame]:
    """Edges (stage, dep_run, name) for stages without dependencies; others that declare the reserved inputs."""
    asked = inputs.filter(F.col("name").isin(*reserved))
    first = stages.join(deps.select("stage").distinct(), "stage", "left_anti").select("stage")
    edges = asked.join(first, "stage", "left_semi").crossJoin(small(run_deps.select("dep_run").distinct())).select("stage", "dep_run", "name").distinct()
    return edges, asked.join(first, "stage", "left_anti").select("stage", "name")


def check_unresolved(inputs: DataFrame, satisfied: DataFrame) -> DataFrame:
    """(stage, name): declared inputs that nothing fills."""
    return inputs.select("stage", "name").join(satisfied.select("stage", "name"), ["stage", "name"], "left_anti")


def wire_steps(step_inputs: DataFrame, step_deps: DataFrame, step_outputs: DataFrame, scatter_inputs: DataFrame) -> DataFrame:
    """(step, name, source): a dependency's output first, then the work item, then the scatter's own inputs; null is an error."""
    made = step_deps.join(step_outputs.select(F.col("step").alias("dep"), "name"), "dep").groupBy("step", "name").agg(F.min("dep").alias("from_dep"))
    out = step_inputs.join(made, ["step", "name"], "left").join(scatter_inputs.select("name").distinct().withColumn("outside", F.lit("scatter")), "name", "left")
    item = F.when(F.col("name") == "worker__item", F.lit("item"))
    return out.select("step", "name", F.coalesce("from_dep", item, "outside").alias("source"))


def check_fanout(steps: Sequence[Step], scatter_outputs: Sequence[str], gather_inputs: Sequence[str], step_inputs: dict[str, Sequence[str]], sink_outputs: Sequence[str]) -> list[str]:
    """Everything wrong with a fan-out's declaration."""
    out = [] if steps else ["a fan-out needs a step"]
    out += [f"scatter lacks output {n}" for n in ("worker__arg", "work__items") if n not in scatter_outputs]
    out += [] if "worker__outs" in gather_inputs else ["gather lacks input worker__outs"]
    heads = [s.name for s in steps if not s.deps]
    if steps and not heads:
        out.append("no step is without dependencies")
    if heads and not any("worker__item" in step_inputs.get(h, ()) for h in heads):
        out.append("no first step takes worker__item")
    try:
        if steps:
            sink_of(steps)
    except ValueError as e:
        out.append(str(e))
    return out if len(sink_outputs) == 1 else [*out, f"the sink has {len(sink_outputs)} outputs, not one"]


def run_graph(runs: DataFrame, run_deps: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed run edges (run, dep_run, dep_type; hard by default) and problems (what, name)."""
    edges = run_deps.select("run", "dep_run", F.coalesce("dep_type", F.lit("hard")).alias("dep_type"))
    twice = runs.groupBy("run").count().filter("count > 1").select(F.lit("duplicate run").alias("what"), F.col("run").alias("name"))
    clash = groups.select(F.col("group").alias("run")).distinct().join(runs.select("run"), "run", "left_semi").select(F.lit("group named like a run"), "run")
    _, left, unknown = levels(runs.select(F.col("run").alias("job_id")), edges.select(F.col("run").alias("job_id"), F.col("dep_run").alias("dep_id")), unknown="ignore")
    return edges, twice.union(clash).union(left.select(F.lit("in or behind a cycle"), "job_id")).union(unknown.select(F.lit("unknown run"), "dep_id"))


def resolve_inputs(edges: DataFrame, outputs: DataFrame, jobs: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """(job_id, target_input, path) for edges (job_id, dep_id, source_output, target_input, mapping_type); unresolved ones.

    A producer's output is that of ``gather`` if it is a fan-out, else of ``main``; ``$out`` becomes its folder.
    ``global`` edges are the store's base, ``inter-run`` edges the source run's metadata (source_run). The producers' outputs
    are found first, so that edges travel once, a slice at a time; those without a producer do not.
    """
    spark = jobs.sparkSession
    places = [shared_path(spark, name) for name in ("edges", "outputs")]
    kind = jobs.select(F.col("job_id").alias("dep_id"), F.when(F.col("stage_type") == "scatter-gather", "gather").otherwise("main").alias("exe"))
    made = outputs.select(F.col("job_id").alias("dep_id"), "exe", F.col("output").alias("source_output"), "template")
    edges = checkpoint(edges, places[0])
    given = checkpoint(kind.join(made, ["dep_id", "exe"]).select("dep_id", "source_output", "template"), places[1])
    path = F.when(F.col("mapping_type") == "global", base).when(F.col("mapping_type") == "inter-run", F.concat(F.lit(f"{base}/runs/"), "source_run", F.lit(".json"))).otherwise(F.replace("template", F.lit("$out"), F.concat(F.lit(f"{base}/"), "dep_id", F.lit("/out"))))

    def found(mine: Callable[[str], Column]) -> DataFrame:
        needy = edges.filter("dep_id is not null").filter(mine("dep_id")).join(given.filter(mine("dep_id")), ["dep_id", "source_output"], "left")
        return needy.select("job_id", "dep_id", "source_output", "target_input", path.alias("path"))

    out = checkpoint_sliced(spark, edges.count() + given.count(), found)
    alone = edges.filter("dep_id is null").withColumn("template", F.lit(None).cast("string"))
    out = out.union(checkpoint(alone.select("job_id", "dep_id", "source_output", "target_input", path.alias("path"))))
    discard(spark, *places)
    return out.filter("path is not null").select("job_id", "target_input", "path"), out.filter("path is null").select("job_id", "dep_id", "source_output")
