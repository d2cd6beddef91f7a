"""Spark helpers of the operators: shared files, bounded filters, skewed joins, components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one block of a bit filter; it is what ``bitmap_construct_agg`` fills.
BLOCK_BITS = 32_768
#: A side of a join is broadcast below so many (narrow) rows, and shuffled above.
BROADCAST_ROWS = 200_000
NULL_ID = -(2**63)
#: Bytes of a batch that goes to Python, but for longer single rows.
BATCH_BYTES = 4_194_304


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, or a temporary one where it is unset (local runs)."""
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


def checkpoint(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder; survives the loss of any executor. Its shuffle files go."""
    shared_dir(df.sparkSession)
    with freeing_shuffles(df.sparkSession):
        return df.select("*").checkpoint()


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
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_gridweave_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-package-")) / "gridweave.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "gridweave").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(archive))
    context._gridweave_shipped = True


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """``rid`` and ``th``: what tells rows apart when results are joined back."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("rid"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th")]


def join_sized(left: DataFrame, right: DataFrame, on, how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A join that broadcasts ``right`` only when it is counted to be small. ``right`` must be cheap to count."""
    return left.join(F.broadcast(right) if right.limit(rows + 1).count() <= rows else right, on, how)


def heavy_limit(total: int) -> int:
    """From so many rows a key is joined by broadcast: at most 16,384 keys, or total / 256 below 4M rows, can have them."""
    return max(256, total // 16_384)


def join_skewed(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """``left`` inner join ``right`` where ``right`` has one row a key with ``n``, the key's rows in ``left``.

    Keys with at least ``heavy_limit(total)`` rows (few, by counting) are broadcast, so none lands in one task;
    the rest is shuffled. Both sides should be cheap to read twice.
    """
    heavy = F.broadcast(right.filter(F.col("n") >= heavy_limit(total)))
    light = right.filter(F.col("n") < heavy_limit(total))
    return left.join(heavy, key).unionByName(left.join(heavy.select(key), key, "left_anti").join(light, key))


def bit_index(hashed: Column, log2_bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - log2_bits)


def filter_blocks(df: DataFrame, hashed: Column, log2_bits: int = 26) -> DataFrame:
    """A bit filter over 64-bit hashes as rows (block, bits) of 4 KB: at most ``2**log2_bits / 8`` bytes at any input size.

    It has no false negatives; a full filter lets all through, which costs time and no correctness.
    """
    at = bit_index(hashed, log2_bits)
    return df.select((at / BLOCK_BITS).cast("long").alias("block"), (at % BLOCK_BITS).alias("at")).groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))


def probe(df: DataFrame, hashed: Column, blocks: DataFrame, log2_bits: int = 26) -> DataFrame:
    """The rows of ``df`` whose hash may be in the filter, by built-in functions alone."""
    names = df.columns
    at = bit_index(hashed, log2_bits)
    hit = df.withColumns({"__block": (at / BLOCK_BITS).cast("long"), "__at": (at % BLOCK_BITS).cast("int")}).join(F.broadcast(blocks.select(F.col("block").alias("__block"), F.col("bits").alias("__bits"))), "__block")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return hit.filter(byte.bitwiseAND(F.expr("shiftleft(1, __at % 8)")) != 0).select(*names)


def filter_bytes(blocks: DataFrame, log2_bits: int) -> np.ndarray:
    """The filter's blocks (bounded by ``log2_bits``) as one array on the driver, for ``in_filter`` on executors."""
    out = np.zeros(max(1, 2**log2_bits // BLOCK_BITS) * BLOCK_BITS // 8, np.uint8)
    for block, bits in blocks.collect():
        out[block * BLOCK_BITS // 8 :][: BLOCK_BITS // 8] = np.frombuffer(bits, np.uint8)
    return out


def in_filter(bits: np.ndarray, hashed: np.ndarray, log2_bits: int) -> np.ndarray:
    at = hashed.astype(np.uint64, copy=False) >> np.uint64(64 - log2_bits)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def complete_runs(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 65_536, pieces: bool = False) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows in which every run of equal keys is whole; the input is sorted by ``keys``.

    With ``pieces``, a run of more than ``rows`` rows is not held: it comes in tables of its own, and its last rows
    begin the table after them.
    """
    held: list[pa.RecordBatch] = []
    n, want = 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < want:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        other = np.zeros(n, bool)
        for k in keys:
            values = table[k].to_numpy()
            other |= values != values[-1]
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if not cut and pieces:
            cut = n
        elif not cut:
            want *= 2  # one long run: look again when it has doubled
            continue
        yield table.slice(0, cut)
        held, n, want = table.slice(cut).to_batches(), n - cut, rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps: every round joins edges with each node's smallest neighbour, found
    by a map-side combined minimum, so hubs are not collected. Rounds end when the edges stay as they are.
    Self edges and nulls are ignored; repeated edges count once.
    """
    e = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == mark or not now[0]:
            break
        mark = tuple(now)
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        e = checkpoint(small.filter("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
