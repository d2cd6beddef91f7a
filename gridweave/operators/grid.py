"""Parameter grids as DataFrames: one typed column a parameter and ``combo_id``, the flat index.

A grid of listed axes is never multiplied out: the row at a flat index is decoded from the index, so a slice of a
huge grid costs what the slice costs and partitions like ``spark.range``. Axes that are columns of tables are joined.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.shared import numbered, small

#: Values of an axis up to which they are part of the plan; longer lists are joined.
LISTED = 1000


class GridError(ValueError):
    """A grid that cannot be expanded as it was written."""


@dataclass(frozen=True)
class Axis:
    """Parameters that move together and their rows; a plain axis has one name."""

    names: tuple[str, ...]
    rows: Sequence[tuple]

    def __len__(self) -> int:
        return len(self.rows)


@dataclass(frozen=True)
class RangeAxis(Axis):
    """Whole numbers, whose ``rows`` are a range."""


def axis_list(name: str, values: Sequence[Any]) -> Axis:
    return Axis((name,), tuple((v,) for v in values))


def axis_range(name: str, first: int, last: int) -> Axis:
    """Whole numbers from ``first`` to ``last``, both included; they are counted out, never listed."""
    return RangeAxis((name,), range(first, last + 1))


def axis_zip(**lists: Sequence[Any]) -> Axis:
    """Lock-step rows of equally long lists."""
    sizes = {n: len(v) for n, v in lists.items()}
    if len(set(sizes.values())) > 1:
        raise GridError("lists of a zip differ in length: " + ", ".join(f"{n} has {k}" for n, k in sizes.items()))
    return Axis(tuple(lists), tuple(zip(*lists.values(), strict=True)))


def axis_column(df: DataFrame, column: str) -> DataFrame:
    """The different values of a column as an axis: (ord, column), in value order."""
    return numbered(df.select(column).distinct(), [column])


def build_axes(params: dict[str, Sequence[Any]], zips: Sequence[Axis] = ()) -> list[Axis]:
    """Single axes in name order without members of zips, then the zips; this order fixes the flat index."""
    taken = {n for z in zips for n in z.names}
    return [axis_list(n, params[n]) for n in sorted(params) if n not in taken] + list(zips)


def grid_size(axes: Sequence[Axis], pipelines: int = 1) -> int:
    size = math.prod(map(len, axes)) * pipelines
    if size >= 2**63:
        raise GridError(f"{size} combinations do not fit a 64-bit index")
    return size


def grid_slice(spark: SparkSession, axes: Sequence[Axis], start: int = 0, end: int | None = None) -> DataFrame:
    """The combinations at flat indexes start to end (cut at the grid's size); the last axis varies fastest."""
    size = grid_size(axes)
    out = spark.range(min(start, size), size if end is None else max(start, min(end, size))).withColumnRenamed("id", "combo_id")
    stride, columns, joined = size, {}, []
    for a in axes:
        stride = stride // max(1, len(a))
        if not len(a):
            columns |= {n: F.lit(None) for n in a.names}
            continue
        at = F.expr(f"combo_id div {stride}") % len(a)
        if isinstance(a, RangeAxis):
            columns[a.names[0]] = at + a.rows[0]
        elif len(a) <= LISTED:
            for k, n in enumerate(a.names):
                columns[n] = F.element_at(F.array(*[F.lit(r[k]) for r in a.rows]), (at + 1).cast("int"))
        else:
            columns[f"__at{len(joined)}"] = at
            joined.append(spark.createDataFrame([(i, *r) for i, r in enumerate(a.rows)], [f"__at{len(joined)}", *a.names]))
    out = out.withColumns(columns) if columns else out
    for i, values in enumerate(joined):
        out = out.join(small(values), f"__at{i}").drop(f"__at{i}")
    return out.select("combo_id", *[n for a in axes for n in a.names])


def expand_grid(spark: SparkSession, axes: Sequence[Axis | DataFrame]) -> DataFrame:
    """All combinations. No axes give one combination, an empty axis gives none.

    Axes may be tables (ord, values) as ``axis_column`` gives them; these are joined on, with the same flat index.
    """
    listed = [a for a in axes if isinstance(a, Axis)]
    if len(listed) == len(axes):
        return grid_slice(spark, axes)
    out = spark.range(1).select(F.lit(0).cast("long").alias("combo_id"))
    for a in axes:
        df = grid_slice(spark, [a]).withColumnRenamed("combo_id", "ord") if isinstance(a, Axis) else a
        size = len(a) if isinstance(a, Axis) else a.count()
        out = out.crossJoin(small(df)).withColumn("combo_id", F.col("combo_id") * size + F.col("ord")).drop("ord")
    return out


def validate_grid(params: dict[str, Any], zips: dict[str, Sequence[str]] | None = None, declared: Sequence[str] = ()) -> list[str]:
    """Everything wrong with a grid: no lists, empty lists, values that are no scalars, members used twice, missing parameters."""
    zips = zips or {}
    out = []
    for n, v in params.items():
        if isinstance(v, (str, bytes)) or not isinstance(v, Sequence):
            out.append(f"{n} is not a list")
        elif not v:
            out.append(f"{n} is empty")
        else:
            out += [f"{n} has a value that is no scalar: {x!r}" for x in v if not isinstance(x, (str, int, float, bool, type(None)))]
    members = [m for ms in zips.values() for m in ms]
    out += [f"{m} is in two zips" for m in sorted({m for m in members if members.count(m) > 1})]
    out += [f"{m} is in a zip and a parameter of its own" for m in sorted(set(members) & set(params))]
    out += [f"{a} names a zip and one of its members" for a, ms in zips.items() if a in ms]
    return out + [f"{d} is declared but not provided" for d in declared if d not in params and d not in members]


def missing_params(declared: DataFrame, provided: DataFrame) -> DataFrame:
    """(stage, param) rows that are declared but not provided (param)."""
    return declared.join(provided.select("param").distinct(), "param", "left_anti").select("stage", "param")


def resolve_defaults(grid: DataFrame, defaults: dict[str, Any]) -> DataFrame:
    """combo_id and only the declared parameters; null or absent ones take their default."""
    have = set(grid.columns)
    return grid.select("combo_id", *[(F.coalesce(F.col(f"`{k}`"), F.lit(v)) if k in have else F.lit(v)).alias(k) for k, v in sorted(defaults.items())])


def derive_params(grid: DataFrame, **columns: Column) -> DataFrame:
    """Attributes as functions of each row's own parameters."""
    return grid.withColumns(columns)


def cross_pipelines(grid: DataFrame, stages: DataFrame) -> DataFrame:
    """Combinations x (pipeline, pos, stage), the plan's rows, which a plan has by definition."""
    return grid.crossJoin(small(stages))


def pick_representatives(jobs: DataFrame, group: str, prefer: Column, has_hints: Column, name: str) -> DataFrame:
    """A row for each group: with hints first, then the preferred, then the first by name."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.when(has_hints, 0).otherwise(1), F.when(prefer, 0).otherwise(1), name))
    return jobs.withColumn("rank", rank).filter("rank = 1").drop("rank")
