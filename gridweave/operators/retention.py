"""Liveness, freshness and integrity reports. Nothing here deletes: reports say what could go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live_set(roots: DataFrame, refs: DataFrame) -> DataFrame:
    """Different artifacts that a root (name, target) reaches over refs (target, artifact); a root that nothing is known of keeps itself."""
    return roots.join(refs, "target").select("artifact").union(roots.join(refs.select("target").distinct(), "target", "left_anti").select(F.col("target").cast(refs.schema["artifact"].dataType))).distinct()


# Fixed value: folders of the store that are compared one level down, entry by entry.
COLLECTIONS = ("host-tools", "images", "image", "jobs", "lab", "revision", "readme", "store")


def live_paths(roots: DataFrame, refs: DataFrame) -> DataFrame:
    """As ``live_set`` for artifacts that are relative paths: the folder at the top of each is live too."""
    live = live_set(roots, refs)
    return live.union(live.select(F.substring_index("artifact", "/", 1))).distinct()


def live_jobs(roots: DataFrame, jobs: DataFrame) -> DataFrame:
    """Different jobs (target, job_id) of what any root refers to."""
    return roots.join(jobs, "target").select("job_id").distinct()


def store_entries(files: DataFrame, collections: tuple[str, ...] = COLLECTIONS) -> DataFrame:
    """Files (path, size) of a store as the entries that live or go as one, (artifact, kind, size): what is directly in the
    store, and in its collections what is directly in these. kind is the name at the top."""
    top, inner = F.substring_index("path", "/", 1), F.substring_index("path", "/", 2)
    return files.select(F.when(top.isin(*collections), inner).otherwise(top).alias("artifact"), top.alias("kind"), "size").groupBy("artifact", "kind").agg(F.sum("size").alias("size"))


def outputs_report(outputs: DataFrame, live: DataFrame) -> DataFrame:
    """(kind, dead, bytes) of job outputs (job_id, size) whose job is not live."""
    dead = outputs.join(live, "job_id", "left_anti").groupBy("job_id").agg(F.sum("size").alias("size"))
    return dead.agg(F.count("*").alias("dead"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).select(F.lit("outputs").alias("kind"), "dead", "bytes")


def sweep_report(store: DataFrame, live: DataFrame, keep: tuple[str, ...] = ("bin",)) -> DataFrame:
    """(kind, dead, bytes) of store entries (artifact, kind, size) that nothing live uses; kept kinds are never dead."""
    dead = store.filter(~F.col("kind").isin(*keep)).join(live, "artifact", "left_anti")
    return dead.groupBy("kind").agg(F.count("*").alias("dead"), F.sum("size").alias("bytes"))


def keep_last_n(roots: DataFrame, n: int = 5) -> DataFrame:
    """All pinned roots, and of each project's others the ``n`` newest by name."""
    rank = F.row_number().over(Window.partitionBy("project", "kind").orderBy(F.desc("name")))
    others = roots.filter("kind <> 'pinned'").withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")
    return roots.filter("kind = 'pinned'").union(others)


def keep_n_and_max_age(logs: DataFrame, n: int, days: int, today: Column) -> DataFrame:
    """The ``n`` newest by name, without those whose date, the second ``_`` part, is more than ``days`` ago; unreadable dates stay."""
    newest = logs.orderBy(F.desc("name")).limit(n)
    date = F.try_to_date(F.get(F.split("name", "_"), F.lit(1)), "yyyy-MM-dd")
    return newest.filter(date.isNull() | (F.date_diff(today, date) <= days))


def list_roots(roots: DataFrame, kind: str | None = None, project: str | None = None) -> DataFrame:
    """Roots by name, of a kind, with a text in their project (a null project never matches)."""
    out = roots if kind is None else roots.filter(F.col("kind") == kind)
    return (out if project is None else out.filter(F.col("project").contains(project))).orderBy("name")


def roots_with_size(roots: DataFrame, refs: DataFrame, sizes: DataFrame, kind: str | None = None, project: str | None = None) -> DataFrame:
    """``list_roots`` with ``bytes``, and a row with a null name for the total, which counts each root in full."""
    each = list_roots(roots, kind, project).select("name", "target")
    return root_size(each, refs, sizes).rollup("name").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def root_size(roots: DataFrame, refs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(name, bytes): what each root refers to; shared artifacts count for each."""
    return roots.select("name", "target").join(refs, "target", "left").join(sizes, "artifact", "left").groupBy("name").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def pinned_only(roots: DataFrame, refs: DataFrame) -> DataFrame:
    """What stays live if all automatic roots go."""
    return live_set(roots.filter("kind = 'pinned'"), refs)


def pin_status(roots: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, pins, autos): names of pinned roots and number of automatic ones with the id in name or target.

    Roots meet ids by their parts of each length that an id has, so no side is multiplied by the other. Empty and null
    ids are in nothing.
    """
    ids = ids.select("id").distinct()
    lengths = [r.k for r in ids.select(F.length("id").alias("k")).filter("k > 0").distinct().collect()]  # as many as ids have lengths

    def parts_of(c: str, k: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(F.col(c), i, F.lit(k)))
        return F.when(F.length(c) >= k, each).otherwise(F.array().cast("array<string>"))

    cut = lambda c: F.flatten(F.array(*[parts_of(c, k) for k in lengths]))
    texts = roots.select("name", "kind", F.coalesce(F.col("target").cast("string"), F.lit("")).alias("__target"))
    parts = texts.select("name", "kind", F.explode(F.array_union(cut("name"), cut("__target"))).alias("id")) if lengths else texts.limit(0).select("name", "kind", F.lit("").alias("id"))
    joined = ids.join(parts, "id", "left")
    return joined.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "pinned", F.col("name")))), ",").alias("pins"), F.count_if(F.col("kind") == "auto").alias("autos"))


def freshness(keys: DataFrame, artifacts: DataFrame, meta: DataFrame) -> DataFrame:
    """(id, state): miss, stale or hit. keys: (id, kind_checked, expected); artifacts: (id); meta: (id, stored)."""
    found = keys.join(artifacts.select("id").distinct().withColumn("there", F.lit(True)), "id", "left").join(meta.select("id", "stored", F.lit(True).alias("known")), "id", "left")
    stale = F.col("kind_checked") & (F.col("stored") != F.col("expected"))
    state = F.when(F.col("there").isNull() | F.col("known").isNull(), "miss").when(F.coalesce(stale, F.lit(False)), "stale").otherwise("hit")
    return found.select("id", state.alias("state"))


def filter_missing(wanted: DataFrame, present: DataFrame, on: str = "id") -> DataFrame:
    return wanted.join(present.select(on).distinct(), on, "left_anti")


def cache_stats(entries: DataFrame) -> DataFrame:
    """(key_type, total, entries, bytes, oldest, newest): the row with ``total`` is that of all types; absent sizes add nothing."""
    rolled = entries.rollup("key_type").agg(F.count("*").alias("entries"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"), F.grouping("key_type").alias("g"))
    return rolled.select("key_type", (F.col("g") == 1).alias("total"), "entries", "bytes", "oldest", "newest")


def verify_manifest(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """(path, state): ok, mismatch, missing or extra for (path, sha256) on both sides."""
    both = manifest.withColumnRenamed("sha256", "want").join(store.withColumnRenamed("sha256", "have"), "path", "full_outer")
    state = F.when(F.col("want").isNull(), "extra").when(F.col("have").isNull(), "missing").when(F.col("want") == F.col("have"), "ok").otherwise("mismatch")
    return both.select("path", state.alias("state"), F.col("want").alias("expected"), F.col("have").alias("actual"))


def merge_first_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """The union of the sources where an earlier source's entry for a key is never replaced."""
    rows = sources[0].withColumn("source", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        rows = rows.unionByName(s.withColumn("source", F.lit(i)))
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct("source", *[c for c in others if c != "source"])).alias("r")).select(key, "r.*")


def pin(roots: DataFrame, new: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots with the new pinned ones (name, target, project), replacing equal names; rows whose target does not exist."""
    good = new.join(store.select("target").distinct(), "target", "left_semi").select("name", F.lit("pinned").alias("kind"), "project", "target")
    stay = roots.join(good.select("name"), "name", "left_anti").select("name", "kind", "project", "target")
    return stay.union(good), new.join(store.select("target").distinct(), "target", "left_anti")


def unpin(roots: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots without the named pinned ones; names that are not pinned."""
    pinned = roots.filter("kind = 'pinned'").select("name")
    gone = names.join(pinned, "name", "left_semi")
    return roots.join(gone.withColumn("kind", F.lit("pinned")), ["name", "kind"], "left_anti").select(roots.columns), names.join(pinned, "name", "left_anti")
