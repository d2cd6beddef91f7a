"""Runs a pipeline of table stages for all combinations, each stage once for each different job key.

A stage is a function of (inputs, params): ``inputs`` maps upstream stages to their rows, re-keyed to this stage's
``job_key``; ``params`` has job_key and the declared parameters, one row a job. Its result carries ``job_key``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.operators.identity import Stage, dedup_jobs, propagate_keys
from gridweave.shared import checkpoint

StageFunction = Callable[[dict[str, DataFrame], DataFrame], DataFrame]


@dataclass(frozen=True)
class SweepStage:
    stage: Stage
    run: StageFunction


@dataclass
class Sweep:
    """keyed: the grid with all keys. results: each stage's rows by job_key."""

    keyed: DataFrame
    results: dict[str, DataFrame]

    def table(self, stage: str, params: list[str]) -> DataFrame:
        """The stage's rows beside every combination that they belong to."""
        return self.keyed.select("combo_id", *params, F.col(f"key_{stage}").alias("job_key")).join(self.results[stage], "job_key")


def run_sweep(grid: DataFrame, stages: list[SweepStage], done: dict[str, DataFrame] | None = None) -> Sweep:
    """All stages. ``done`` holds earlier results by stage: keys found there are not computed again.

    The keys are computed once, and so is every result that more than one stage reads: both are kept in the shared folder.
    Results that one stage reads, and final ones, stay lazy.
    """
    keyed = checkpoint(propagate_keys(grid, [s.stage for s in stages]))
    readers = Counter(d for s in stages for d in dict.fromkeys(s.stage.deps))
    results: dict[str, DataFrame] = {}
    for s in stages:
        jobs = dedup_jobs(keyed, s.stage)
        before = (done or {}).get(s.stage.name)
        if before is not None:
            jobs = jobs.join(before.select("job_key").distinct(), "job_key", "left_anti")
        inputs = {}
        for d in dict.fromkeys(s.stage.deps):
            links = jobs.select(F.col("job_key").alias("to"), F.col(f"key_{d}").alias("job_key"))
            inputs[d] = results[d].join(links, "job_key").drop("job_key").withColumnRenamed("to", "job_key")
        out = s.run(inputs, jobs.drop(*[f"key_{d}" for d in s.stage.deps]))
        out = out if before is None else before.unionByName(out)
        results[s.stage.name] = checkpoint(out) if readers[s.stage.name] > 1 else out
    return Sweep(keyed, results)


def stage_sum(df: DataFrame, column: str, key: str = "job_key") -> DataFrame:
    return df.groupBy(key).agg(F.sum(column).alias("total"))


def stage_concat(first: DataFrame, second: DataFrame, key: str = "job_key") -> DataFrame:
    """first's rows, then second's, numbered anew from 0 in ``ord``, which both have."""
    both = first.withColumn("part", F.lit(0)).unionByName(second.withColumn("part", F.lit(1)))
    return both.withColumn("ord", (F.row_number().over(Window.partitionBy(key).orderBy("part", "ord")) - 1).cast("long")).drop("part")


def row_at(df: DataFrame, wanted: DataFrame, key: str = "job_key") -> DataFrame:
    """The rows at (job_key, ord) of ``wanted``."""
    return df.join(wanted, [key, "ord"])


def generate(params: DataFrame, n: int, **series: Column) -> DataFrame:
    """``n`` rows (x = 0, 1, ...) a job, with columns computed from x and the parameters."""
    return params.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumns(series)


def stage_scale(jobs: DataFrame, values: DataFrame, by: str, key: str = "job_key") -> DataFrame:
    """value * parameter for each job; 0 where a job has no value."""
    return jobs.join(values.select(key, "value"), key, "left").select(key, (F.coalesce("value", F.lit(0)) * F.col(by)).alias("scaled"))


def list_arg_reduce(text: Column, offset: Column) -> Column:
    """The sum of the whole numbers in a text of white-space-separated arguments, each with the offset added."""
    numbers = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long") + offset)


def collect_numeric(df: DataFrame, name: str, contains: str, value: str) -> DataFrame:
    """Rows whose name contains a text and whose value is a number."""
    return df.filter(F.col(name).contains(contains)).withColumn("number", F.col(value).try_cast("double")).filter("number is not null")


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """bin (1..bins), low, high, n over [min, max]; the last bin is closed, empty bins are there."""
    spark = df.sparkSession
    edge = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) * bins / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1)) + 1, F.lit(bins)).cast("long")
    counts = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(edge)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = spark.range(1, bins + 1).withColumnRenamed("id", "bin").crossJoin(F.broadcast(edge))
    width = (F.col("hi") - F.col("lo")) / bins
    return every.join(counts, "bin", "left").select("bin", (F.col("lo") + width * (F.col("bin") - 1)).alias("low"), (F.col("lo") + width * F.col("bin")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def compare_sweep(results: DataFrame, index: str, label: str, value: str, labels: list) -> DataFrame:
    """Curves side by side: one column a label, given explicitly."""
    return results.groupBy(index).pivot(label, labels).agg(F.first(value))


@dataclass(frozen=True)
class Threshold:
    """An axis of a sweep that selects rows: those whose ``column`` is ``op`` (``<=``, ``>=`` or ``=``) one of ``values``."""

    name: str
    column: str
    op: str
    values: tuple


def threshold_sweep(df: DataFrame, axes: Sequence[Threshold], sums: dict[str, Column]) -> DataFrame:
    """The axes' names, ``n`` and the ``sums``, for every combination of the axes' values, over the rows that it selects.

    One scan for all combinations: a row is counted in its cell, the place of its values among the sorted thresholds, and
    each combination's rows are those of whole cells, added up along one axis after the other by running sums. So the
    work on rows does not grow with the number of combinations. Rows with a null in a column are in none; combinations
    without rows have n = 0 and sums of 0; repeated values count once. Sums of decimals and integers are exact.
    """
    bins, names = [], [a.name for a in axes]
    lists = [sorted(set(a.values)) for a in axes]
    for a, values in zip(axes, lists, strict=True):
        x, every = F.col(a.column), F.array(*map(F.lit, values))
        if a.op == "<=":  # the first threshold that reaches it
            place = F.size(F.filter(every, lambda v: v < x))  # noqa: B023
            place = F.when(place < len(values), place)
        elif a.op == ">=":
            place = F.size(F.filter(every, lambda v: v <= x)) - 1  # noqa: B023
            place = F.when(place >= 0, place)
        elif a.op == "=":
            place = F.array_position(every, x).cast("int") - 1
            place = F.when(place >= 0, place)
        else:
            raise ValueError(f"{a.name}: {a.op} is none of <=, >=, =")
        bins.append(F.when(x.isNotNull(), place).alias(f"__{a.name}"))
    cells = df.select(*bins, *(v.alias(k) for k, v in sums.items())).dropna(subset=[f"__{n}" for n in names])
    cells = cells.groupBy(*[f"__{n}" for n in names]).agg(F.count("*").alias("n"), *(F.sum(k).alias(k) for k in sums))
    total = math.prod(map(len, lists))
    if total >= 2**63:
        raise ValueError("more combinations than a number can count")
    spans = [math.prod(map(len, lists[i + 1 :])) for i in range(len(lists))]
    grid = df.sparkSession.range(total).select(*(F.expr(f"cast((id div {span}) % {len(v)} as int)").alias(f"__{n}") for n, v, span in zip(names, lists, spans, strict=True)))
    out = grid.join(cells, [f"__{n}" for n in names], "left")
    for a in axes:
        if a.op != "=":
            others = [f"__{n}" for n in names if n != a.name]
            order = F.col(f"__{a.name}") if a.op == "<=" else F.desc(f"__{a.name}")
            upto = Window.partitionBy(*others).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
            out = out.select(*[f"__{n}" for n in names], *(F.sum(c).over(upto).alias(c) for c in ("n", *sums)))
    chosen = [F.element_at(F.array(*map(F.lit, v)), F.col(f"__{n}") + 1).alias(n) for n, v in zip(names, lists, strict=True)]
    return out.select(*chosen, *(F.coalesce(c, F.lit(0).cast(out.schema[c].dataType)).alias(c) for c in ("n", *sums)))
