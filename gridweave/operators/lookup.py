"""Filters, lookups and flat views over collections of jobs."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.ids import stage_of
from gridweave.shared import checkpoint, numbered, small

_OPS = {"startswith": Column.startswith, "endswith": Column.endswith, "contains": Column.contains}


def _condition(value: Column, op: str | None, wanted: Any) -> Column:
    if op in _OPS:
        return _OPS[op](value.cast("string"), str(wanted))
    return value.cast("string") == str(wanted) if not isinstance(wanted, (int, float, bool)) else value == F.lit(wanted)


def where(df: DataFrame, predicate: Column | Callable[[DataFrame], Column] | None = None, **equal: Any) -> DataFrame:
    """Rows that meet the predicate and all of ``name=value``, ``name__startswith|endswith|contains=text`` and
    ``param_<name>[__op]=value`` (the effective parameter map ``eff``). An unknown name matches nothing; an unknown
    operator warns and compares the whole value."""
    if predicate is not None:
        df = df.filter(predicate if isinstance(predicate, Column) else predicate(df))
    for key, wanted in equal.items():
        name, _, op = key.partition("__")
        if op and op not in _OPS:
            warnings.warn(f"unknown operator {op!r}: comparing the whole value", stacklevel=2)
        if name.startswith("param_") and name not in df.columns and "eff" in df.columns:
            value = F.col("eff")[name.removeprefix("param_")]
        elif name in df.columns:
            value = F.col(f"`{name}`")
        else:
            return df.filter(F.lit(False))
        df = df.filter(_condition(value, op or None, wanted))
    return df


def search(df: DataFrame, text: str, params: str | None = "eff") -> DataFrame:
    """Plain text: in id, name or run, any case. ``%col term`` parts are all met; a column is named by a prefix of id,
    name (item), run, params, status; others are ignored; params match a key, a value or ``key=value``."""
    contains = lambda c, t: F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(t.lower()))
    text = text.strip()
    if not text.startswith("%"):
        return df.filter(contains("job_id", text) | contains("name", text) | contains("run", text)) if text else df
    known = {"id": "job_id", "name": "name", "item": "name", "run": "run", "params": "params", "status": "status"}
    for part in text.split("%")[1:]:
        column, _, term = part.strip().partition(" ")
        hit = next((c for n, c in known.items() if column and n.startswith(column.lower())), None)
        if hit is None or not term.strip():
            continue
        term = term.strip()
        if hit != "params":
            df = df.filter(contains(hit, term))
        elif params in df.columns:
            low, both = F.lit(term.lower()), F.map_entries(F.col(params))
            df = df.filter(F.coalesce(F.exists(both, lambda e: F.contains(F.lower(e.key), low) | F.contains(F.lower(e.value), low) | F.contains(F.lower(F.concat(e.key, F.lit("="), e.value)), low)), F.lit(False)))
    return df


def where_status(jobs: DataFrame, statuses: DataFrame, *wanted: str) -> DataFrame:
    """Jobs in any of the states; without a known state a job is pending."""
    return jobs.join(statuses.select("job_id", "status"), "job_id", "left").withColumn("status", F.coalesce("status", F.lit("pending"))).filter(F.col("status").isin(*wanted))


def where_stage(jobs: DataFrame, text: str) -> DataFrame:
    return jobs.filter(F.col("job_id").contains(text))


def lookup(ids: DataFrame, prefixes: DataFrame, at_least: int = 0) -> DataFrame:
    """(prefix, n, result, first, last) for a table of prefixes: not found, match or ambiguous.

    Every join is on equal texts: prefixes of at least ``at_least`` characters meet ids by that many and are compared,
    shorter ones meet the ids' beginnings of each length that a prefix has. A null prefix is not found.
    """
    own = prefixes.select("prefix").distinct()
    longer = F.length("prefix") >= at_least if at_least else F.lit(False)
    short = own.filter(F.col("prefix").isNull() | ~longer)
    lengths = [r.k for r in short.select(F.length("prefix").alias("k")).filter("k is not null").distinct().collect()]  # as many as prefixes have lengths
    starts = ids.select("job_id", F.explode(F.array(*[F.lit(k) for k in lengths]).cast("array<int>")).alias("k")).filter(F.length("job_id") >= F.col("k"))
    joined = short.join(starts.select("job_id", F.substring(F.col("job_id"), F.lit(1), F.col("k")).alias("prefix")), "prefix", "left").select("prefix", "job_id")
    if at_least:
        a = ids.select("job_id", F.substring("job_id", 1, at_least).alias("k"))
        met = own.filter(longer).withColumn("k", F.substring("prefix", 1, at_least)).join(a, "k", "left")
        joined = joined.union(met.select("prefix", F.when(F.col("job_id").startswith(F.col("prefix")), F.col("job_id"))))
    n = F.countDistinct("job_id")
    result = F.when(n == 0, "not found").when(n == 1, "match").otherwise("ambiguous")
    return joined.groupBy("prefix").agg(n.alias("n"), result.alias("result"), F.min("job_id").alias("first"), F.max("job_id").alias("last"))


def select_runs(runs: DataFrame, groups: DataFrame, spec: str) -> DataFrame:
    """``@group`` gives its runs; unknown and empty groups raise with the known ones. Else the run of that name."""
    if not spec.startswith("@"):
        return runs.filter(F.col("run") == spec)
    inside = groups.filter((F.col("group") == spec[1:]) & F.col("run").isNotNull())
    if inside.isEmpty():
        raise ValueError(f"group {spec[1:]!r} is unknown or empty; groups: {[r.group for r in groups.select('group').distinct().orderBy('group').limit(100).collect()]}")
    return runs.join(inside, "run", "left_semi")


def flattened(eff: DataFrame) -> DataFrame:
    """Parameters (job_id, k, v) with JSON objects taken apart: ``k.inner`` for each of their fields, down to what is no object."""
    done, left = eff.limit(0).select("job_id", "k", "v"), eff.select("job_id", "k", "v")
    while True:
        inner = F.from_json(F.when(F.ltrim("v").startswith("{"), F.col("v")), "map<string,string>")
        split = checkpoint(left.withColumn("inner", inner))
        done = done.union(split.filter("inner is null").select("job_id", "k", "v"))
        left = split.filter("inner is not null").select("job_id", "k", F.explode("inner").alias("f", "x")).select("job_id", F.concat("k", F.lit("."), "f").alias("k"), F.col("x").alias("v"))
        if left.isEmpty():
            return done


def to_table(jobs: DataFrame, eff: DataFrame, keys: Sequence[str] | None = None, flatten: bool = True) -> DataFrame:
    """One row a job: job_id, name and effective parameters (job_id, k, v) as columns; without keys one query lists them.

    Nested objects become dotted columns, as ``flattened`` gives them.
    """
    if flatten:
        eff = flattened(eff)
    if keys is None:
        keys = [r.k for r in eff.select("k").distinct().orderBy("k").collect()]  # parameter names, as many as columns
    wide = eff.groupBy("job_id").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in keys]) if keys else eff.select("job_id").distinct()
    return jobs.select("job_id", "name").join(wide, "job_id", "left")


def at_positions(df: DataFrame, order: Sequence[str], start: int, end: int) -> DataFrame:
    """Rows start to end (excluded) in the given order, which ranges of rows are sorted and counted for; no task gets them all."""
    placed = numbered(df, list(order), "__place")
    return placed.filter((F.col("__place") >= start) & (F.col("__place") < end)).orderBy("__place").drop("__place")


def run_of(jobs: DataFrame, run_jobs: DataFrame, missing: str = "null") -> DataFrame:
    """(job_id, run): a job of several runs (run, job_id, ord) is in the last; one of no run has null or, with ``error``, raises."""
    if missing == "error":
        lost = jobs.select("job_id").join(run_jobs, "job_id", "left_anti").orderBy("job_id").limit(20).collect()
        if lost:
            raise KeyError(f"jobs of no run, the first: {[r.job_id for r in lost]}")
    return jobs.select("job_id").join(run_jobs.groupBy("job_id").agg(F.max_by("run", "ord").alias("run")), "job_id", "left")


def runs_of_prefix(run_jobs: DataFrame, prefix: str) -> DataFrame:
    return run_jobs.filter(F.col("job_id").startswith(prefix)).select("run").distinct().orderBy("run")


def group_by_stage(jobs: DataFrame) -> DataFrame:
    """(stage, n, first) by the stage name inside the ids."""
    return jobs.withColumn("stage", stage_of(F.col("job_id"))).groupBy("stage").agg(F.count("*").alias("n"), F.min("job_id").alias("first"))


def stage_members(jobs: DataFrame) -> DataFrame:
    """(stage, ord, job_id): the ids of each stage in order, from 0; a row for each, as a stage may have any number."""
    placed = numbered(jobs.select(stage_of(F.col("job_id")).alias("stage"), "job_id"), ["stage", "job_id"], "__place")
    first = placed.groupBy("stage").agg(F.min("__place").alias("__first"))
    same = F.col("stage").eqNullSafe(F.col("__stage"))
    return placed.join(small(first.withColumnRenamed("stage", "__stage")), same).select("stage", (F.col("__place") - F.col("__first")).alias("ord"), "job_id")


def job_profile(jobs: DataFrame, statuses: DataFrame, eff: DataFrame, edges: DataFrame, outputs: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """One wide row a job: run, status, parameters, different inputs and outputs, and hints (job_id, exe, mem, cpus, time) of
    its sub-stages, as sorted arrays."""
    listed = lambda df, c, name: df.groupBy("job_id").agg(F.array_sort(F.collect_set(c)).alias(name))
    out = jobs.join(statuses, "job_id", "left").join(listed(eff, F.struct("k", "v"), "params"), "job_id", "left")
    out = out.join(listed(edges, "dep_id", "inputs"), "job_id", "left").join(listed(outputs, "output", "outputs"), "job_id", "left")
    return out if hints is None else out.join(listed(hints, F.struct("exe", "mem", "cpus", "time"), "hints"), "job_id", "left")


def group_sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy("group").agg(F.countDistinct("run").alias("runs")).orderBy("group")
