"""The folder that driver and executors share, joins with counted sides, and row numbers without a single task."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many (narrow) rows.
BROADCAST_ROWS = 200_000
#: Bytes of a batch that goes to Python, but for longer single rows.
BATCH_BYTES = 16_777_216
#: Bytes in memory for each byte of kept rows, as Spark is to estimate them: an id takes under one in Parquet, 140 in a broadcast.
IN_MEMORY = 1000
#: Rows that one slice of ``checkpoint_sliced`` shuffles.
SLICE_ROWS = 25_000_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder in local runs without one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """DataFrames made inside drop the shuffle files of each run of theirs when it ends; else these stay until the driver
    happens to collect its garbage. A session that sets this itself keeps its choice."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(key, None) is None
    if own:
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        if own:
            spark.conf.unset(key)


def _as_rows(df: DataFrame) -> bool:
    """Whether Parquet cannot hold it: columns without a type or of one name."""
    kinds = [t for _, t in df.dtypes]
    return not kinds or any("void" in t or "interval" in t for t in kinds) or len({c.lower() for c in df.columns}) < len(kinds)


def checkpoint(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df``, computed once and kept in the shared folder as Parquet, which takes a fraction of what its rows would and is
    read by column; its shuffle files go. What Parquet cannot hold is kept as rows. A caller that names the ``path`` can
    ``discard`` it.

    Spark takes a table's size in files for its size in memory, and would broadcast many millions of kept rows; so the
    session's factor between them is set, unless the session sets its own. Sides that a shuffle has measured are still broadcast.
    """
    spark = df.sparkSession
    with freeing_shuffles(spark):
        if _as_rows(df):
            shared_dir(spark)
            return df.select("*").checkpoint()
        if spark.conf.get("spark.sql.sources.fileCompressionFactor", None) is None:
            spark.conf.set("spark.sql.sources.fileCompressionFactor", str(float(IN_MEMORY)))
        path = path or shared_path(spark, "rows")
        df.select("*").write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint_sliced(spark: SparkSession, rows: int, make: Callable[[Callable[[str], Column]], DataFrame], path: str | None = None) -> DataFrame:
    """What ``make`` returns, kept for one slice of keys after the other, so that no more than some ``SLICE_ROWS`` of its
    ``rows`` are shuffled at a time and lie on disk twice.

    ``make`` gets a function that says of a key's column which rows are in the slice. It applies that to all that it joins or
    groups by the key; what it reads is read once a slice, so it should be kept. Slices are equal in hash, nulls are in one.
    """
    n = max(1, -(-rows // SLICE_ROWS))
    mine = lambda i: lambda key: F.lit(True) if n == 1 else F.pmod(F.xxhash64(key), F.lit(n)) == i
    if n == 1 or _as_rows(make(mine(0))):
        return checkpoint(make(lambda key: F.lit(True)), path)
    path = path or shared_path(spark, "rows")
    parts = [checkpoint(make(mine(i)), f"{path}/{i}") for i in range(n)]
    return spark.read.schema(parts[0].schema).parquet(*[f"{path}/{i}" for i in range(n)])


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes kept rows that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _bytes(text: str) -> int:
    digits = "".join(c for c in text if c.isdigit() or c == "-")
    return int(digits or 0) * {"k": 2**10, "m": 2**20, "g": 2**30}.get(text.strip().lower().removesuffix("b")[-1:], 1)


def ship(spark: SparkSession) -> None:
    """Makes this package importable on executors whose PYTHONPATH lacks it, and batches for Python fit for whole texts.

    Spark's defaults, 10,000 rows and any number of bytes a batch, are for short rows; a session that sets its own
    numbers keeps them.
    """
    for key, default, own in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", None, str(BATCH_BYTES))):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}", None)
        if now == default or default is None and (now is None or not 0 < _bytes(now) < 2**31):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", own)
    root = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_gridweave_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-package-")) / "gridweave.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "gridweave").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(archive))
    context._gridweave_shipped = True


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows; it should be cheap to count."""
    with freeing_shuffles(df.sparkSession):
        few = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with all rows of equal keys in one partition, for code that works on whole partitions.

    A plain repartition is left out where joins or aggregates below have dealt by the same keys; these may be changed
    while they run, as nothing above them asks for their partitioning any more. A hash of the keys is always dealt anew.
    """
    return df.repartition(F.xxhash64(*keys))


def numbered(df: DataFrame, by: list[str | Column], name: str = "ord") -> DataFrame:
    """``df`` with row numbers from 0 in the order of ``by``: ranges are sorted and counted, and numbered from where the last one ended."""
    local = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    local = checkpoint(local.withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit(2**33 - 1))}).drop("__id"))
    counts = local.groupBy("__part").agg(F.count("*").alias("n"))  # a row for each partition
    starts = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__start"))
    return local.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")
