"""Exact de-duplication by a log-structured merge index of digests, in built-in functions alone.

* Memtables: every input split of a batch sorts its (digest, doc_id, text) rows and flushes them as one sorted file of
  level 0. No shuffle is involved; the text column is read again only for verification.
* Runs: a batch's files merge into a run of level 1, one row a digest with the smallest identifier and the count. The sum
  is combined inside each task first, so a digest that a third of all rows share is a few rows in the shuffle. Every run
  has a filter, a bitmap of fixed size over its digests without false negatives.
* Compaction: as soon as a level has ``fanout`` runs they merge into one run of the next level, which keeps the smallest
  identifiers; so a batch meets few runs however many came before.
* A new batch probes each run's filter, and reads only the runs that may hold one of its digests.
* Byte verification: digests met more than once, in this batch or before, are hits. Only stored texts whose digest may
  be a hit are read again and compared, grouped by digest *and* text. Should one digest stand for different texts, its
  rows are settled by their text.

``DigestIndex.add`` judges a batch against all that came before; ``exact_duplicates`` is one batch through it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm._spark import checkpoint, filter_blocks, join_skewed, probe, shared_path
from gridweave.llm._text import SPACE

ROW, RUN, FILTER = "doc_id long, digest binary, norm string", "digest binary, keep_id long, n long", "block long, bits binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"{SPACE}+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _merged(rows: DataFrame) -> DataFrame:
    """One row a digest of runs' rows: the smallest identifier and the sum of the counts."""
    return rows.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))


@dataclass(frozen=True)
class Run:
    """A sorted run under ``path``/run, its filter under ``path``/filter, and the batches that it holds."""

    path: str
    level: int
    batches: tuple[int, ...]


class DigestIndex:
    """Sorted digest runs in levels under ``path``, in the folder that all executors share.

    ``read`` lists the runs that the last batch had to read. Runs that a compaction replaced stay on disk, as results
    already handed out may still read them; ``replaced`` lists their paths.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, digest=sha256, fanout: int = 4):
        self.spark, self.path, self.digest, self.fanout = spark, path or shared_path(spark, "digest-index"), digest, fanout
        self.batches = 0
        self.runs: list[Run] = []
        self.read: list[Run] = []
        self.replaced: list[str] = []

    def _rows(self, batch: int) -> DataFrame:
        return self.spark.read.schema(ROW).parquet(f"{self.path}/level=0/batch={batch}")

    def _read(self, run: Run) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(f"{run.path}/run")

    def _filter(self, run: Run) -> DataFrame:
        return self.spark.read.schema(FILTER).parquet(f"{run.path}/filter")

    def flush(self, docs: DataFrame) -> int:
        """Writes a batch's memtables, one sorted file a task; its number."""
        norm = normalised(F.col("text"))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm")).select("doc_id", self.digest(F.col("norm")).alias("digest"), "norm")
        rows.sortWithinPartitions("digest", "doc_id").write.parquet(f"{self.path}/level=0/batch={self.batches}")
        self.batches += 1
        return self.batches - 1

    def _write(self, rows: DataFrame, level: int, batches: tuple[int, ...]) -> Run:
        run = Run(f"{self.path}/level={level}/batches={batches[0]}-{batches[-1]}", level, batches)
        rows.sortWithinPartitions("digest").write.parquet(f"{run.path}/run")
        filter_blocks(self._read(run), F.xxhash64("digest")).write.parquet(f"{run.path}/filter")
        return run

    def _hits(self, own: Run) -> list[tuple[Run, DataFrame]]:
        """The older runs that may hold digests of ``own``, with the digests that may be there."""
        out = []
        for run in self.runs:
            maybe = checkpoint(probe(self._read(own).select("digest"), F.xxhash64("digest"), self._filter(run)))
            if not maybe.isEmpty():
                out.append((run, maybe))
        return out

    def compact(self) -> None:
        """Merges the runs of every level that has ``fanout`` of them into one run of the next."""
        while full := next((level for level in {r.level for r in self.runs} if sum(r.level == level for r in self.runs) >= self.fanout), None):
            old = [r for r in self.runs if r.level == full]
            rows = _merged(reduce(DataFrame.union, map(self._read, old)))
            new = self._write(rows, full + 1, tuple(sorted(b for r in old for b in r.batches)))
            self.runs = [r for r in self.runs if r.level != full] + [new]
            self.replaced += [r.path for r in old]

    def add(self, docs: DataFrame) -> DataFrame:
        """doc_id, keep_id, group_size, kept and text_sha256 of the batch's rows, judged with all batches so far."""
        batch = self.flush(docs)
        each = self._rows(batch)
        own = self._write(_merged(each.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))), 1, (batch,))
        older = self._hits(own)
        self.read = [run for run, _ in older]
        mine = self._read(own)
        merged = mine.withColumn("size", F.col("n"))
        if older:
            before = reduce(DataFrame.union, [self._read(run).join(maybe, "digest", "left_semi") for run, maybe in older])
            known = checkpoint(_merged(before)).select("digest", F.col("keep_id").alias("old_id"), F.col("n").alias("old_n"))
            # nulls never win: least() passes them over
            merged = mine.join(known, "digest", "left").select("digest", "n", F.least("keep_id", "old_id").alias("keep_id"), (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("size"))
            merged = checkpoint(merged)
        self.runs.append(own)
        out = self._verified(each, merged, sorted({batch, *(b for run, _ in older for b in run.batches)}))
        self.compact()
        return out

    def _verified(self, each: DataFrame, merged: DataFrame, batches: list[int]) -> DataFrame:
        """The result for the batch's rows after a comparison of all stored texts whose digest was hit."""
        hits = checkpoint(filter_blocks(merged.filter("size > 1"), F.xxhash64("digest")))
        stored = reduce(DataFrame.union, map(self._rows, batches))
        groups = probe(stored, F.xxhash64("digest"), hits).groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("size"))
        clash = checkpoint(groups.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"))
        total = each.count()
        out = ("doc_id", "keep_id", F.col("size").alias("group_size"), "digest")
        rows = each.select("doc_id", "digest")
        if clash.isEmpty():
            found = join_skewed(rows, merged, "digest", total).select(*out)
        else:
            plain = join_skewed(rows.join(clash, "digest", "left_anti"), merged.join(clash, "digest", "left_anti"), "digest", total).select(*out)
            apart = checkpoint(groups.join(clash, "digest", "left_semi").withColumn("same", F.sha2("norm", 512)).select("same", "keep_id", "size"))
            again = each.join(clash, "digest", "left_semi").select("doc_id", F.sha2("norm", 512).alias("same"), "digest")
            found = plain.union(again.join(apart, "same").select(*out))
        return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_duplicates(docs: DataFrame, digest=sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of ``docs`` (doc_id, text).

    Texts are equal when they are after each run of ASCII white space became one space; null counts as empty. The
    row with the smallest doc_id of its group stays. Null ids never win against others; rows that repeat the
    smallest doc_id of a group are one document and are all marked kept. An empty table gives an empty result.
    """
    return DigestIndex(docs.sparkSession, digest=digest).add(docs)
