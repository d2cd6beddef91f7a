"""Listings and tails of files; contents are read only where they are asked for."""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions.ids import literal, sha256_hex
from gridweave.shared import checkpoint, ship

#: Bytes of a file that one task reads at a time, and files that one task looks up or writes.
SPLIT_BYTES, FILES_A_TASK = 64 << 20, 2048
#: Bytes of lines given on together.
BLOCK_BYTES = 4 << 20


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    system, at = _at(spark, path)
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    system, at = _at(spark, path)
    out = system.create(at, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a small file that is whole as soon as it is there, unless there is one: True if it was made.

    A local file is linked to its place. Other file systems make a file only where there is none in one step.
    """
    system, at = _at(spark, path)
    if system.getUri().getScheme() == "file":
        place = Path(at.toUri().getPath())
        place.parent.mkdir(parents=True, exist_ok=True)
        draft = place.parent / f".{uuid.uuid4().hex}"
        draft.write_text(text)
        try:
            os.link(draft, place)
            return True
        except FileExistsError:
            return False
        finally:
            draft.unlink()
    try:
        write_text(spark, path, text, overwrite=False)
        return True
    except Py4JJavaError:
        if not system.exists(at):
            raise
        return False


def _listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


@lru_cache(maxsize=16)
def _system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark takes it (nothing is escaped), and the place there; Arrow knows local, HDFS, S3,
    GCS and Azure ones."""
    scheme, named, rest = path.partition("://")
    if path.startswith("file:") or not named:
        return fs.LocalFileSystem(), os.path.abspath(re.sub("^(file:)?/+", "/", path))
    authority, _, place = rest.partition("/")
    system, root = _system(f"{scheme}://{authority}/")
    return system, f"{root.rstrip('/')}/{place}"


def _found(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The rows with ``file`` and ``bytes`` for each file that their path names; both null where there is none."""
    for batch in batches:
        at, file, size = [], [], []
        for i, p in enumerate(batch.column(path).to_pylist()):
            held = []
            if p is not None:
                system, place = _opened(p)
                info = system.get_file_info(place)
                if info.type == fs.FileType.Directory:  # as Spark writes what is one file to others
                    held = [x for x in system.get_file_info(fs.FileSelector(place)) if x.is_file and x.base_name[0] not in "._"]
                elif info.is_file:
                    held = [info]
            for x in sorted(held, key=lambda x: x.path):
                at.append(i)
                file.append(p if len(held) == 1 and x.path == place else f"{p.rstrip('/')}/{x.base_name}")
                size.append(x.size)
            if not held:
                at.append(i)
                file.append(None)
                size.append(None)
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns), pa.array(file, pa.string()), pa.array(size, pa.int64())], [*batch.schema.names, "file", "bytes"])


def _schema(df: DataFrame, more: str) -> str:
    return "".join(f"`{n}` {t}, " for n, t in df.dtypes) + more


def find_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """``paths`` with ``file`` and ``bytes``: a row for each file that a row's path names, itself or the files of a folder.

    A path without a file has one row with nulls, as has a null path. Tasks look files up, some hundreds each; the
    driver lists none.
    """
    ship(paths.sparkSession)
    kept = checkpoint(paths)
    tasks = max(1, -(-kept.count() // FILES_A_TASK))
    return kept.repartition(tasks).mapInArrow(lambda it: _found(it, path), _schema(paths, "file string, bytes long"))


def _lines(batches: Iterable[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """The lines of the files of a batch; small files share blocks."""
    for batch in batches:
        of, offsets, values, size = [], [], [], 0
        for i, (file, start, end) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "__start", "__end")), strict=True)):
            system, place = _opened(file)
            with io.BufferedReader(system.open_input_file(place), min(1 << 20, max(1 << 12, end - start))) as f:
                at = start
                if start:  # the line that began before is the last task's, as is one that begins right here
                    f.seek(start - 1)
                    at += len(f.readline()) - 1
                while whole or at < end:
                    line = f.read() if whole else f.readline()
                    if not line and not whole:
                        break
                    of.append(i)
                    offsets.append(at)
                    values.append((line if whole else line.rstrip(b"\r\n")).decode("utf-8", "replace"))
                    at, size = at + len(line), size + len(line)
                    if size > BLOCK_BYTES:
                        yield _with(batch, of, offsets, values)
                        of, offsets, values, size = [], [], [], 0
                    if whole:
                        break
        if of:
            yield _with(batch, of, offsets, values)


def _with(batch: pa.RecordBatch, of: list[int], offsets: list[int], values: list[str]) -> pa.RecordBatch:
    row, at = batch.drop_columns(["__start", "__end"]), pa.array(of, pa.int64())
    return pa.RecordBatch.from_arrays([*(c.take(at) for c in row.columns), pa.array(offsets, pa.int64()), pa.array(values, pa.string())], [*row.schema.names, "offset", "value"])


def _written(batches: Iterable[pa.RecordBatch], header: str | None) -> Iterator[pa.RecordBatch]:
    """Writes each run of rows (path, value) of one path as its file, a line a value; null values write none."""
    paths, sizes = [], []
    each = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for path, rows in groupby(each, lambda r: r[0]):
        system, place = _opened(path)
        folder, _, name = place.rpartition("/")
        draft = f"{folder}/.{name}-{uuid.uuid4().hex}"  # of this attempt; a file is whole as soon as it is there
        system.create_dir(folder)
        size = 0
        with io.BufferedWriter(system.open_output_stream(draft), 1 << 16) as out:
            if header is not None:
                size += out.write(f"{header}\n".encode())
            for _, value in rows:
                if value is not None:
                    size += out.write(f"{value}\n".encode())
        system.move(draft, place)
        paths.append(path)
        sizes.append(size)
        if len(paths) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])
            paths, sizes = [], []
    if paths:
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])


def write_files(rows: DataFrame, path: str, line: str, header: str | None = None) -> int:
    """Writes a file for each different path, whose lines are the path's sorted values, under a header line if there is
    one; returns how many. Null values write no line, so a path with nothing else is an empty file; rows without a path
    write nothing.

    Tasks write the files, thousands each, through drafts that are renamed; a file's lines stream through one task.
    """
    ship(rows.sparkSession)
    given = rows.filter(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(line).cast("string").alias("value"))
    n = given.agg(F.approx_count_distinct("path")).first()[0]
    placed = given.repartition(max(1, -(-n // FILES_A_TASK)), "path").sortWithinPartitions("path", "value")
    return placed.mapInArrow(lambda it: _written(it, header), "path string, bytes long").count()


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, str, bool]] = []

    def block(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.bool_()), strict=True)], ["folder", "name", "is_folder"])

    for batch in batches:
        for folder in batch.column("folder").to_pylist():
            system, place = _opened(folder)
            held += ((folder, x.base_name, x.type == fs.FileType.Directory) for x in system.get_file_info(fs.FileSelector(place, allow_not_found=True)))
            while len(held) >= 10_000:
                yield block(held[:10_000])
                held = held[10_000:]
    if held:
        yield block(held)


def list_folders(folders: DataFrame) -> DataFrame:
    """(folder, name, is_folder) of what lies directly in each ``folder``; tasks list them, a folder each at a time. A
    folder that is not there has nothing."""
    ship(folders.sparkSession)
    kept = checkpoint(folders.select("folder"))
    tasks = max(1, -(-kept.count() // FILES_A_TASK))
    return kept.repartition(tasks).mapInArrow(_entries, "folder string, name string, is_folder boolean")


def read_files(files: DataFrame, whole: bool = False) -> DataFrame:
    """The lines of files that ``find_files`` has found, beside its columns: ``offset``, the line's byte in its file, and
    ``value``; with ``whole`` a row for each file, from byte 0.

    Files are dealt out among tasks, large ones in splits of ``SPLIT_BYTES``. Bytes that are no UTF-8 become U+FFFD.
    """
    ship(files.sparkSession)
    there = files.filter("file is not null")
    step = F.lit(SPLIT_BYTES)
    starts = F.array(F.lit(0).cast("long")) if whole else F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), step.cast("long"))
    split = checkpoint(there.withColumn("__start", F.explode(starts)).withColumn("__end", F.col("bytes") if whole else F.least("bytes", F.col("__start") + step)))
    size, n = split.agg(F.coalesce(F.sum(F.col("__end") - F.col("__start")), F.lit(0)), F.count("*")).first()
    tasks = max(1, -(-size // SPLIT_BYTES), -(-n // FILES_A_TASK))
    return split.repartition(tasks).mapInArrow(lambda it: _lines(it, whole), _schema(files, "offset long, value string"))


def scan_paths(spark: SparkSession, folder: str, kind: str = "any", match: str = ".*") -> DataFrame:
    """(path, kind) directly inside a folder, by path; ``match`` covers the whole name. Only this level is listed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    found = spark.createDataFrame([(f.getPath().getName(), "directory" if f.isDirectory() else "file") for f in listed], "name string, kind string")
    found = found.filter(F.col("name").rlike(f"^(?:{match})$"))
    if kind != "any":
        found = found.filter(F.col("kind") == kind)
    return found.select(F.concat(F.lit(folder.rstrip("/") + "/"), "name").alias("path"), "kind").orderBy("path")


def tail_lines(files: DataFrame, n: int, key: str = "job_id", text: str = "value") -> DataFrame:
    """(key, pos, line): the last ``n`` lines of each text, pos from 0; a newline at the end begins no line."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\n$", ""), "\n", -1)
    last = F.when(F.size(lines) > n, F.slice(lines, F.size(lines) - n + 1, F.lit(n))).otherwise(lines)
    return files.filter(F.coalesce(F.length(text), F.lit(0)) > 0).select(key, F.posexplode(last).alias("pos", "line"))


def list_outputs(spark: SparkSession, jobs: DataFrame, outputs: str) -> DataFrame:
    """(job_id, file, bytes, state) of files under ``<outputs>/<job_id>/``; jobs without any are not executed."""
    at = "^.*?" + literal(outputs.rstrip("/")) + "/([^/]+)/(.+)$"
    files = _listed(spark, outputs).select(F.regexp_extract("path", at, 1).alias("job_id"), F.regexp_extract("path", at, 2).alias("file"), F.col("length").alias("bytes"))
    return jobs.select("job_id").join(files, "job_id", "left").withColumn("state", F.when(F.col("file").isNull(), "not executed").otherwise("executed"))


def hashed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256) of all files below a folder, paths relative to it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return rows.select(F.regexp_replace("path", "^.*?" + literal(folder.rstrip("/")) + "/", "").alias("path"), sha256_hex(F.col("content")).alias("sha256"))
