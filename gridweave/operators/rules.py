"""Layered rules: defaults, then an entity's own hints, then all matching rules in order; the last value set wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.ids import glob_to_regex
from gridweave.shared import small


def _matches(entity_name: str, entity_target: str) -> Column:
    fits = F.col("target").isNull() | (F.col("target") == F.col(entity_target))
    return fits & (F.col("glob").isNull() | F.rlike(F.col(entity_name), glob_to_regex(F.col("glob"))))


def resolve_rules(entities: DataFrame, rules: DataFrame, key: str, name: str, target: str, fields: list[str], lists: list[str] = (), defaults: dict | None = None) -> DataFrame:
    """The entities' key and resolved fields. ``rules`` has ord, glob, target and the fields; it is written by hand.

    A rule matches if its target is absent or equal and its glob is absent or matches the whole name. An entity's own
    columns of a field's name are its hints. A list field is replaced only by one that has entries.
    """
    r = small(rules.select("ord", "glob", "target", *[F.col(f).alias(f"rule_{f}") for f in [*fields, *lists]]))
    own = entities.withColumnRenamed(target, "__target") if target == "target" else entities.withColumn("__target", F.col(target))
    hits = own.select(key, F.col(name).alias("__name"), "__target").join(r, _matches("__name", "__target"))
    last = [F.max_by(f"rule_{f}", F.when(F.col(f"rule_{f}").isNotNull(), F.col("ord"))).alias(f"rule_{f}") for f in fields]
    last += [F.max_by(f"rule_{f}", F.when(F.size(f"rule_{f}") > 0, F.col("ord"))).alias(f"rule_{f}") for f in lists]
    found = entities.join(hits.groupBy(key).agg(*last), key, "left")
    defaults = defaults or {}
    value = lambda f: F.coalesce(f"rule_{f}", *([F.col(f)] if f in entities.columns else []), F.lit(defaults.get(f)))
    return found.select(key, *[value(f).alias(f) for f in [*fields, *lists]])


def resolve_worker_rules(entities: DataFrame, rules: DataFrame, key: str, name: str, target: str, fields: list[str], defaults: dict | None = None) -> DataFrame:
    """As ``resolve_rules``, then worker hints (columns worker_<field>), then the struct ``worker`` of the last matching rule only."""
    base = resolve_rules(entities, rules, key, name, target, fields, defaults=defaults)
    r = small(rules.select("ord", "glob", "target", "worker"))
    hits = entities.select(key, F.col(name).alias("__name"), F.col(target).alias("__target")).join(r, _matches("__name", "__target"))
    last = hits.groupBy(key).agg(F.max_by("worker", "ord").alias("worker"))
    hints = [f"worker_{f}" for f in fields if f"worker_{f}" in entities.columns]
    out = base.join(last, key, "left").join(entities.select(key, *hints), key, "left")
    return out.select(key, *[F.coalesce(F.col("worker")[f], *([F.col(f"worker_{f}")] if f"worker_{f}" in hints else []), F.col(f)).alias(f) for f in fields])
