"""Content keys of stage rows: equal inputs give equal keys, so equal work is recognised and computed once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.ids import canonical_params, content_id, sha256_hex
from gridweave.shared import checkpoint, small


@dataclass(frozen=True)
class Stage:
    """A stage's identity: name, version, declared parameters with defaults, and upstream stages, one for each mapping.

    ``code`` is a fingerprint of its code (pure identity); without it the name and version stand for the code.
    ``parts`` are the fingerprints of a fan-out: scatter, steps by name, gather.
    """

    name: str
    version: str = "1.0"
    params: dict[str, Any] = field(default_factory=dict)
    deps: tuple[str, ...] = ()
    code: str | None = None
    parts: dict[str, str] | None = None
    mappings: str = "[]"

    def identities(self) -> list[str]:
        if self.code is None and self.parts is None:
            return [f"{self.name}-{self.version}"]
        if self.parts is None:
            return [self.code]
        return [self.parts["scatter"], *(v for k, v in sorted(self.parts.items()) if k not in ("scatter", "gather")), self.parts["gather"]]


def job_key(stage: Stage, params_json: Column, deps: Sequence[Column]) -> Column:
    """``<id>-<name>-<version>``; the id hashes identities, parameters, upstream keys and mappings."""
    deps_json = F.to_json(F.array(*deps)) if deps else F.lit("[]")
    joined = F.concat_ws(":", *deps) if deps else F.lit("")
    fields = [*map(F.lit, stage.identities()), params_json, deps_json, sha256_hex(joined), F.lit(stage.mappings)]
    return F.concat(content_id(*fields), F.lit(f"-{stage.name}-{stage.version}"))


def key_tree(keys: DataFrame, key: str, order: str = "combo_id", block: int = 4096) -> list[DataFrame]:
    """Levels (at, digest) of a Merkle tree over a run's keys in flat-index order: a node is the digest of the nodes at
    ``block`` consecutive places below it, the root is alone in the last level. A row never holds more than a block."""
    if block < 2:
        raise ValueError(f"a node has two children at least, not {block}")
    digest = sha256_hex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), ":"))
    level, levels = keys.select(F.col(order).cast("long").alias("at"), F.col(key).alias("digest")), []
    while not levels or levels[-1].limit(2).count() > 1:
        level = checkpoint(level.groupBy(F.expr(f"at div {block}").alias("up")).agg(digest.alias("digest")).select(F.col("up").alias("at"), "digest"))
        levels.append(level)
    return levels


def run_digest(keys: DataFrame, key: str, order: str = "combo_id", block: int = 4096) -> DataFrame:
    """One digest of a run's keys, the root of ``key_tree``: one row (run_digest), null for a run without keys."""
    return key_tree(keys, key, order, block)[-1].agg(F.max("digest").alias("run_digest"))


def changed_keys(old: DataFrame, new: DataFrame, key: str, order: str = "combo_id", block: int = 4096, trees: tuple[list[DataFrame], list[DataFrame]] | None = None) -> DataFrame:
    """(at, old, new) where two runs' keys differ or one has none; only blocks whose digests differ are compared.

    ``trees`` are both runs' ``key_tree`` with this ``block``, if they are kept; from the root down, a level is joined for
    the nodes whose parents differ only.
    """
    a, b = trees or (key_tree(old, key, order, block), key_tree(new, key, order, block))
    differ = None
    for i in range(max(len(a), len(b)) - 1, -1, -1):
        sides = [t[i].select("at", F.col("digest").alias(n)) if i < len(t) else None for t, n in ((a, "old"), (b, "new"))]
        if differ is not None:
            sides = [s if s is None else s.withColumn("up", F.expr(f"at div {block}")).join(small(differ), "up", "left_semi").drop("up") for s in sides]
        if None in sides:  # one tree is higher: all below it may differ
            differ = checkpoint(next(s for s in sides if s is not None).select(F.col("at").alias("up")))
            continue
        differ = checkpoint(sides[0].join(sides[1], "at", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new"))).select(F.col("at").alias("up")))
    rows = [df.select(F.col(order).cast("long").alias("at"), F.col(key).alias(n)).withColumn("up", F.expr(f"at div {block}")).join(small(differ), "up", "left_semi").drop("up") for df, n in ((old, "old"), (new, "new"))]
    return rows[0].join(rows[1], "at", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))


def propagate_keys(grid: DataFrame, stages: Sequence[Stage], upstream_runs: dict[str, DataFrame] | None = None) -> DataFrame:
    """``grid`` with ``key_<stage>`` for each stage, in order. ``upstream_runs``: stage -> a run's digest to depend on."""
    out, given = grid, set(grid.columns)
    for s in stages:
        resolved = {k: (F.coalesce(F.col(f"`{k}`"), F.lit(v)) if k in given else F.lit(v)) for k, v in s.params.items()}
        params = F.to_json(F.struct(*[resolved[k].alias(k) for k in sorted(resolved)]), {"ignoreNullFields": "false"}) if resolved else canonical_params([])
        deps = [F.col(f"key_{d}") for d in s.deps]
        if upstream_runs and s.name in upstream_runs:
            out = out.crossJoin(F.broadcast(upstream_runs[s.name]))  # one row
            deps.append(F.col("run_digest"))
        out = out.withColumn(f"key_{s.name}", job_key(s, params, deps))
        out = out.drop("run_digest")
    return out


def dedup_jobs(keyed: DataFrame, stage: Stage) -> DataFrame:
    """The stage's different jobs: key, its declared parameters and upstream keys; one row a key."""
    have = set(keyed.columns)
    cols = [F.coalesce(F.col(f"`{k}`"), F.lit(v)).alias(k) if k in have else F.lit(v).alias(k) for k, v in sorted(stage.params.items())]
    return keyed.select(F.col(f"key_{stage.name}").alias("job_key"), *cols, *[f"key_{d}" for d in dict.fromkeys(stage.deps)]).dropDuplicates(["job_key"])


def dedup_report(keyed: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """stage, total and unique rows."""
    rows = keyed.select(F.explode(F.array(*[F.struct(F.lit(s.name).alias("stage"), F.col(f"key_{s.name}").alias("k")) for s in stages])).alias("r"))
    return rows.groupBy("r.stage").agg(F.count("*").alias("total"), F.countDistinct("r.k").alias("unique"))


def plan_diff(old: DataFrame, new: DataFrame, on: Sequence[str] = ("stage", "combo_id")) -> DataFrame:
    """same, changed, added or removed for every (stage, combo_id) of two plans with column ``key``."""
    both = old.withColumnRenamed("key", "old_key").join(new.withColumnRenamed("key", "new_key"), list(on), "full_outer")
    status = F.when(F.col("old_key").isNull(), "added").when(F.col("new_key").isNull(), "removed").when(F.col("old_key") == F.col("new_key"), "same").otherwise("changed")
    return both.withColumn("status", status)
