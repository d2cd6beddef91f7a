"""Scatter, per-branch steps and gather; (job_id, branch_idx) is a branch, whose order is its index."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from gridweave.shared import checkpoint, dealt, ship, small

#: Branches of one piece of a gather whose pieces can be merged.
PIECE = 100_000


@dataclass(frozen=True)
class Step:
    """A step of a branch, in one of three forms.

    ``value`` is a Column made of the item, its dependencies' outputs and the job's columns. ``rows`` is a function of a
    DataFrame with job_id and branch_idx that returns these and a column of the step's name. ``code`` is a Python
    function of one branch: it gets a dict of the item, the job's columns, the outputs of ``deps`` and, if the step
    ``reads`` a DataFrame with job_id and branch_idx, ``rows``, the list of the branch's rows there as dicts (null keys
    match nothing, branches without rows have an empty list; a branch's rows fit one row), and returns a value of
    ``returns``. What it raises is kept in ``<name>_error``, and steps that depend on it are not run for that branch.
    """

    name: str
    deps: tuple[str, ...] = ()
    value: Column | None = None
    rows: Callable[[DataFrame], DataFrame] | None = None
    code: Callable[[dict[str, Any]], Any] | None = None
    returns: str = "string"
    reads: DataFrame | None = None


class FanOutError(ValueError):
    pass


def scatter(jobs: DataFrame, items: str) -> DataFrame:
    """One row an item of the array, ``branch_idx`` from 0; empty and null arrays have no branches."""
    return jobs.select(*[c for c in jobs.columns if c != items], F.posexplode(items).alias("branch_idx", "item"))


def step_order(steps: Sequence[Step]) -> list[Step]:
    """The steps with each after its dependencies; unknown ones and cycles raise."""
    by, out = {s.name: s for s in steps}, []
    for s in steps:
        if unknown := set(s.deps) - by.keys():
            raise FanOutError(f"step {s.name} depends on unknown {sorted(unknown)}")
    left = list(steps)
    while left:
        ready = [s for s in left if all(d in {o.name for o in out} for d in s.deps)]
        if not ready:
            raise FanOutError(f"steps in a cycle: {sorted(s.name for s in left)}")
        out += ready
        left = [s for s in left if s not in ready]
    return out


def sink_of(steps: Sequence[Step]) -> str:
    used = {d for s in steps for d in s.deps}
    sinks = [s.name for s in steps if s.name not in used]
    if len(sinks) != 1:
        raise FanOutError(f"a fan-out has one sink, not {sinks}")
    return sinks[0]


def _plain(column: pa.Array) -> list:
    """A column as a Python list; whole numbers without nulls go as one piece."""
    if column.null_count == len(column):
        return [None] * len(column)
    return column.to_numpy().tolist() if not column.null_count and pa.types.is_integer(column.type) else column.to_pylist()


def _listed(column: pa.ListArray) -> list[list[dict]]:
    """Lists of structs as Python's, by column; value by value it takes several times as long."""
    fields = [_plain(column.values.field(i)) for i in range(column.type.value_type.num_fields)]
    names, at = [f.name for f in column.type.value_type], column.offsets.to_pylist()
    each = [dict(zip(names, r, strict=True)) for r in zip(*fields, strict=True)]
    return [each[a:b] for a, b in zip(at, at[1:], strict=False)]


def _values(values: list, failed: list[str | None], kind: pa.DataType) -> pa.Array:
    """The values as ``kind``; what cannot be one fails alone."""
    try:
        return pa.array(values, kind)
    except Exception:
        for i, x in enumerate(values):
            try:
                values[i] = pa.scalar(x, kind).as_py()
            except Exception as e:
                values[i], failed[i] = None, f"{type(e).__name__}: {e}"
        return pa.array(values, kind)


def _coded(batches: Iterable[pa.RecordBatch], step_name: str, code: Callable, kind: pa.DataType, seen: list[str], errors: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs a step's code on each branch of batches that hold many; an error stays with its branch."""
    for batch in batches:
        values, failed = [], []
        columns = [_listed(batch.column(c)) if c == "rows" and pa.types.is_list(batch.column(c).type) and pa.types.is_struct(batch.column(c).type.value_type) else _plain(batch.column(c)) for c in (*seen, *errors)]
        names = (*seen, *errors)
        for row in zip(*columns, strict=True):
            branch = dict(zip(names, row, strict=True))
            if errors and (broken := [e.removesuffix("_error") for e in errors if branch.pop(e) is not None]):
                values.append(None)
                failed.append(f"not run: {', '.join(broken)} failed")
                continue
            try:
                values.append(code(branch))
                failed.append(None)
            except Exception as e:  # the branch's own, whatever it is
                values.append(None)
                failed.append(f"{type(e).__name__}: {e}")
        kept = [n for n in batch.schema.names if n != "rows"] if "rows" in seen else batch.schema.names
        made = _values(values, failed, kind)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), made, pa.array(failed, pa.string())], [*kept, step_name, f"{step_name}_error"])


def _run_code(out: DataFrame, step: Step, others: set[str]) -> DataFrame:
    ship(out.sparkSession)
    if step.reads is not None:
        given = step.reads.groupBy("job_id", "branch_idx").agg(F.collect_list(F.struct(*[c for c in step.reads.columns if c not in ("job_id", "branch_idx")])).alias("rows"))
        out = out.join(given, ["job_id", "branch_idx"], "left").withColumn("rows", F.coalesce("rows", F.array().cast(given.schema["rows"].dataType)))
    errors = [f"{d}_error" for d in step.deps if f"{d}_error" in out.columns]
    hidden = (others - set(step.deps)) | {f"{n}_error" for n in others}
    seen = [c for c in out.columns if c not in hidden]
    kind, code, name = to_arrow_type(DataType.fromDDL(step.returns)), step.code, step.name
    schema = ", ".join(f"`{n}` {t}" for n, t in out.dtypes if step.reads is None or n != "rows") + f", `{name}` {step.returns}, `{name}_error` string"
    return out.mapInArrow(lambda it: _coded(it, name, code, kind, seen, errors), schema)


def run_steps(branches: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """The branches with a column for each step (and ``<name>_error`` for code); column steps of one level fuse into one
    projection, and code runs where its branches lie."""
    sink_of(steps)
    out, names = branches, {s.name for s in steps}
    for s in step_order(steps):
        if s.value is not None:
            out = out.withColumn(s.name, s.value)
        elif s.code is not None:
            out = _run_code(out, s, names)
        else:
            out = out.join(s.rows(out).select("job_id", "branch_idx", s.name), ["job_id", "branch_idx"], "left")
    return out


def gather(branches: DataFrame, value: str) -> DataFrame:
    """(job_id, items): each job's values in branch order. A job's branches must fit one row; prefer plain aggregates."""
    pairs = F.array_sort(F.collect_list(F.struct("branch_idx", F.col(value).alias("v"))))
    return branches.groupBy("job_id").agg(F.transform(pairs, lambda x: x["v"]).alias("items"))


def _streamed(batches: Iterable[pa.RecordBatch], kinds: list[pa.DataType], fn: Callable[[Iterator], Any], kind: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
    """One call of ``fn`` for each run of equal keys, the first columns, over an iterator of (branch_idx, value) behind them;
    a null branch_idx is no branch."""
    n = len(kinds)
    made: list[tuple] = []

    def rows() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), [*kinds, kind, pa.string()], strict=True)]
        made.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    each = (row for batch in batches for row in zip(*map(_plain, batch.columns), strict=True))
    for key, run in groupby(each, lambda r: r[:n]):
        try:
            value, error = pa.scalar(fn((r[n], r[n + 1]) for r in run if r[n] is not None), kind).as_py(), None
        except Exception as e:
            value, error = None, f"{type(e).__name__}: {e}"
        for _ in run:  # what the function left
            pass
        made.append((*key, value, error))
        if len(made) == 1000:
            yield rows()
    if made:
        yield rows()


def gather_stream(branches: DataFrame, value: str, fn: Callable[[Iterator], Any], returns: str, jobs: DataFrame | None = None) -> DataFrame:
    """(job_id, gathered, error): one call of ``fn`` for each job over an iterator of (branch_idx, value) in branch order.

    Jobs are dealt out by id and each partition is sorted by job and branch, so a job of any length streams through
    bounded memory. With ``jobs`` (job_id), those without branches are gathered from an empty iterator. An error stays
    with its job. One function over an ordered job is one task's work; use ``gather_merge`` where it can be split.
    """
    ship(branches.sparkSession)
    rows = branches.select("job_id", F.col("branch_idx").cast("long").alias("branch_idx"), F.col(value).alias("v"))
    if jobs is not None:
        rows = rows.union(jobs.select("job_id", F.lit(None).cast("long"), F.lit(None).cast(rows.schema["v"].dataType)))
    kind, key = to_arrow_type(DataType.fromDDL(returns)), rows.schema["job_id"].dataType
    kinds = [to_arrow_type(key)]
    placed = dealt(rows, "job_id").sortWithinPartitions("job_id", "branch_idx")
    return placed.mapInArrow(lambda it: _streamed(it, kinds, fn, kind, ["job_id", "gathered", "error"]), f"job_id {key.simpleString()}, gathered {returns}, error string")


def gather_merge(branches: DataFrame, value: str, fn: Callable[[Iterator], Any], state: str, merge: Callable[[Iterator], Any], returns: str, piece: int = PIECE, jobs: DataFrame | None = None) -> DataFrame:
    """(job_id, gathered, error) as ``gather_stream``, for functions that can be split: ``fn`` makes a ``state`` of each piece of
    consecutive branches (branch_idx div ``piece``), ``merge`` the result from an iterator of (piece, state) in order.

    A job that holds most branches is so many tasks' work as it has pieces.
    """
    ship(branches.sparkSession)
    rows = branches.select("job_id", F.expr(f"branch_idx div {piece}").alias("piece"), F.col("branch_idx").cast("long").alias("branch_idx"), F.col(value).alias("v"))
    kind, key = to_arrow_type(DataType.fromDDL(state)), rows.schema["job_id"].dataType
    kinds = [to_arrow_type(key), pa.int64()]
    placed = dealt(rows, "job_id", "piece").sortWithinPartitions("job_id", "piece", "branch_idx")
    states = placed.mapInArrow(lambda it: _streamed(it, kinds, fn, kind, ["job_id", "piece", "state", "error"]), f"job_id {key.simpleString()}, piece long, state {state}, error string")

    def merged(items: Iterator) -> Any:
        def states_of() -> Iterator:
            for at, x in items:
                if x["error"] is not None:
                    raise FanOutError(x["error"])
                yield at, x["state"]

        return merge(states_of())

    return gather_stream(states.select("job_id", F.col("piece").alias("branch_idx"), F.struct("state", "error").alias("s")), "s", merged, returns, jobs)


@dataclass(frozen=True)
class FanOut:
    """Scatter, steps and gather as one: ``items`` is the jobs' array column (or a function of the jobs that returns their
    branches), ``gather`` a function of an iterator of (branch_idx, output of the sink), which ``returns`` a value.

    With ``merge`` the gather is split in pieces: ``gather`` then makes a ``state`` of each.
    """

    items: str | Callable[[DataFrame], DataFrame]
    steps: tuple[Step, ...]
    gather: Callable[[Iterator], Any]
    returns: str
    merge: Callable[[Iterator], Any] | None = None
    state: str = "string"

    def run(self, jobs: DataFrame) -> DataFrame:
        """(job_id, branches, done, first_missing, complete, gathered, error): one row a job. Jobs with a branch whose sink
        failed are not gathered; their ``error`` is null and ``complete`` false. Jobs without branches are complete."""
        sink = sink_of(self.steps)
        branches = scatter(jobs, self.items) if isinstance(self.items, str) else self.items(jobs)
        done = run_steps(branches, self.steps)
        failed = [F.col(f"{s.name}_error").isNotNull() for s in self.steps if s.code is not None]
        ok = ~reduce(Column.__or__, failed) if failed else F.lit(True)
        done = checkpoint(done.select("job_id", "branch_idx", F.col(sink).alias("__v"), ok.alias("__ok")))
        # counted once; what follows reads a row for each job
        gate = checkpoint(jobs.select("job_id").distinct().join(completeness_gate(done, F.col("__ok")), "job_id", "left"))
        broken = gate.filter("not complete").select("job_id")
        whole = gate.filter("complete is null or complete").select("job_id")
        ready = done.join(small(broken), "job_id", "left_anti")
        if self.merge is None:
            got = gather_stream(ready, "__v", self.gather, self.returns, whole)
        else:
            got = gather_merge(ready, "__v", self.gather, self.state, self.merge, self.returns, jobs=whole)
        zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("branches", "done")]
        return gate.join(got, "job_id", "left").select("job_id", *zero, "first_missing", F.coalesce("complete", F.lit(True)).alias("complete"), "gathered", "error")


def completeness_gate(branches: DataFrame, ok: Column) -> DataFrame:
    """(job_id, branches, done, first_missing, complete): gathering waits until every branch succeeded."""
    got = branches.groupBy("job_id").agg(F.count("*").alias("branches"), F.count_if(ok).alias("done"), F.min(F.when(~ok, F.col("branch_idx"))).alias("first_missing"))
    return got.withColumn("complete", F.col("done") == F.col("branches"))


def stale_branches(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(job_id, branch_idx, state): same, changed, new or dropped by comparing ``item``; nulls compare equal."""
    a = previous.select("job_id", "branch_idx", F.struct("item").alias("old"))
    b = current.select("job_id", "branch_idx", F.struct("item").alias("new"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "dropped").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return a.join(b, ["job_id", "branch_idx"], "full_outer").select("job_id", "branch_idx", state.alias("state"))


def side_outputs(gathered: DataFrame, scatter_outputs: DataFrame) -> DataFrame:
    """The scatter's other outputs beside what was gathered."""
    return gathered.join(scatter_outputs, "job_id", "left")


def expected_units(branch_counts: DataFrame, steps: DataFrame) -> DataFrame:
    """(job_id, unit, phase): a scatter, each step of each branch, a gather; branch_counts is (job_id, branches)."""
    ends = branch_counts.select("job_id", F.explode(F.array(F.struct(F.lit("scatter").alias("unit"), F.lit("scatter").alias("phase")), F.struct(F.lit("gather").alias("unit"), F.lit("gather").alias("phase")))).alias("u")).select("job_id", "u.unit", "u.phase")
    rows = branch_counts.filter("branches > 0").select("job_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("branches").cast("long") - 1)).alias("b"))
    each = rows.crossJoin(F.broadcast(steps))  # the step list is written by hand
    return ends.union(each.select("job_id", F.concat(F.col("step"), F.lit(":"), F.col("b").cast("string")), F.lit("step")))


def unit_progress(expected: DataFrame, done: DataFrame) -> DataFrame:
    """(job_id, units, finished) from expected and finished (job_id, unit)."""
    marked = expected.join(done.select("job_id", "unit").distinct().withColumn("ok", F.lit(1)), ["job_id", "unit"], "left")
    return marked.groupBy("job_id").agg(F.count("*").alias("units"), F.count("ok").alias("finished"))
