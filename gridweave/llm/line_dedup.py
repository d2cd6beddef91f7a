"""Line de-duplication over range-partitioned line hashes.

Lines become rows (hash, document, position). They are range-partitioned by hash and document, so that a line which
a third of all documents share spreads over many partitions, and sorted inside each by hash, document, position. One
streaming pass sees each hash's documents in order: up to the limit it holds back a few rows, from the limit on it
passes positions straight through. Only a partition's first and last hash can go on next door; their counts (two
rows a partition and a few held rows) are added up afterwards. What comes out is a compressed keep bitmap for each
document, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm._spark import checkpoint, row_key, ship
from gridweave.llm._text import LOWER, SPACE, UPPER, raw

BLANKS = " \t\n\x0b\f\r"


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h1, h2, rid, pos, th): a 128-bit hash of every line's key that has at least ``min_chars`` code points."""
    texts = docs.select(*row_key(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))  # a text is hashed once, not for each line
    lines = texts.select("rid", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(BLANKS)), UPPER, LOWER)
    return lines.withColumn("key", key).filter(F.length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "rid", "pos", "th")


_OUT = pa.schema([("rid", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("docs", pa.int64()), ("sure", pa.bool_())])


def _batch(rows: np.ndarray, docs, sure: bool) -> pa.RecordBatch:
    """rows: int64 columns h1, h2, rid, pos, th."""
    n = len(rows)
    h1, h2, rid, pos, th = (np.ascontiguousarray(rows[:, i]) for i in range(5))
    docs = np.broadcast_to(np.asarray(docs, np.int64), (n,))
    return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(th), pa.array(pos.astype(np.int32)), pa.array(h1), pa.array(h2), pa.array(docs), pa.array(np.full(n, sure))], schema=_OUT)


def _stream(batches: Iterable[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Positions of lines known to be in ``min_docs`` documents (sure), and what the neighbours must know.

    For a first or last hash: its rows with docs = 1 at each new document (held), or, once it reached the limit here,
    one row with the count and position -1.
    """
    head: tuple | None = None  # the partition's first hash
    held, seen, last = np.zeros((0, 5), np.int64), 0, None  # of the hash that goes on: rows, documents so far, last document

    def close(key: tuple, edge: bool) -> Iterator[pa.RecordBatch]:
        if seen < min_docs and edge and len(held):
            new = np.concatenate([[True], held[1:, 2] != held[:-1, 2]])
            yield _batch(held, new, False)
        elif seen >= min_docs and edge:
            yield _batch(np.array([[*key, 0, -1, 0]], np.int64), seen, False)

    key = None
    for b in batches:
        rows = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2", "rid", "pos", "th")], axis=1)
        if not len(rows):
            continue
        edge = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        starts = np.concatenate([[0], edge])
        ends = np.concatenate([edge, [len(rows)]])
        inner = slice(1, -1) if len(starts) > 2 else slice(0, 0)
        if len(starts) > 2:  # hashes that begin and end inside this batch, all at once
            lo, hi = int(starts[1]), int(starts[-1])
            part = rows[lo:hi]
            new = np.concatenate([[True], (part[1:, :3] != part[:-1, :3]).any(axis=1)]).astype(np.int64)
            at = starts[inner] - lo
            often = np.repeat(np.add.reduceat(new, at) >= min_docs, np.diff(np.concatenate([at, [hi - lo]])))
            if often.any():
                yield _batch(part[often], 0, True)
        for s, e in [(starts[0], ends[0]), *([(starts[-1], ends[-1])] if len(starts) > 1 else [])]:
            own = rows[s:e]
            now = (int(own[0, 0]), int(own[0, 1]))
            if now != key:
                if key is not None:
                    yield from close(key, key == head)
                head = head or now
                key, held, seen, last = now, held[:0], 0, None
            new = np.concatenate([[last is None or own[0, 2] != last], own[1:, 2] != own[:-1, 2]])
            seen, last = seen + int(new.sum()), own[-1, 2]
            held = np.concatenate([held, own]) if len(held) else own
            if seen >= min_docs:
                yield _batch(held, 0, True)
                held = held[:0]
    if key is not None:
        yield from close(key, True)


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(rid, th, pos) of every line whose key is in at least ``min_docs`` documents."""
    ship(docs.sparkSession)
    ranged = line_hashes(docs, min_chars).repartitionByRange("h1", "h2", "rid").sortWithinPartitions("h1", "h2", "rid", "pos")
    found = checkpoint(ranged.mapInArrow(lambda it: _stream(it, min_docs), "rid long, th long, pos int, h1 long, h2 long, docs long, sure boolean"))
    edges = found.filter("not sure")
    often = edges.groupBy("h1", "h2").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("h1", "h2")
    # held rows are fewer than min_docs documents for each edge, so this join is as small as the partitions are few
    late = edges.filter("pos >= 0").join(often, ["h1", "h2"], "left_semi")
    return found.filter("sure").select("rid", "th", "pos").union(late.select("rid", "th", "pos"))


def _with_lines(docs: DataFrame, columns: list[str], min_docs: int, min_chars: int) -> DataFrame:
    """The rows with ``__text`` and ``__gone``, the sorted positions to drop."""
    gone = dropped_lines(docs, min_docs, min_chars).groupBy("rid", "th").agg(F.array_sort(F.collect_set("pos")).alias("__gone"))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text")
    rows = docs.select(*columns, text, *(c.alias(f"__{n}") for c, n in zip(row_key(), ("rid", "th"), strict=True)))
    return rows.join(gone.withColumnsRenamed({"rid": "__rid", "th": "__th"}).hint("shuffle_hash"), ["__rid", "__th"], "left").drop("__rid", "__th")


def _keep(n: int, gone: list[int] | None) -> np.ndarray:
    keep = np.ones(n, bool)
    if gone:
        keep[gone] = False
    return keep


def packed(keep: np.ndarray) -> bytes:
    """A keep bitmap: bit i of the uncompressed bytes, lowest first, is line i."""
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)


def unpacked_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines, bitorder="little").astype(bool)


def kept_text(text: bytes, bitmap: bytes, n_lines: int) -> bytes:
    return b"\n".join(x for x, k in zip(text.split(b"\n"), unpacked_bitmap(bitmap, n_lines), strict=True) if k)


def _bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], []]
        for text, gone in zip(raw(b.column("__text")), b.column("__gone").to_pylist(), strict=True):
            n = text.count(b"\n") + 1
            keep = _keep(n, gone)
            bitmap = packed(keep)
            for v, x in zip(out, (n, n - int(keep.sum()), bitmap, hashlib.sha256(kept_text(text, bitmap, n) if gone else text).hexdigest()), strict=True):
                v.append(x)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.string())], ["doc_id", "n_lines", "n_dropped", "keep_bitmap", "kept_sha256"])


def line_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep_bitmap (compressed, see ``packed``) and kept_sha256 for every row.

    Texts split at newlines (null or empty: one empty line). A line's key is the line without ASCII white space at both
    ends, A-Z in lower case; keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose
    all their lines. Rows that repeat a doc_id count as one document; null ids together are one document. Exact for
    lines of any length and any number of repeats. An empty table gives an empty result.
    """
    rows = _with_lines(docs, [F.col("doc_id").cast("long").alias("doc_id")], min_docs, min_chars)
    return rows.select("doc_id", "__text", "__gone").mapInArrow(_bitmaps, "doc_id long, n_lines long, n_dropped long, keep_bitmap binary, kept_sha256 string")


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for text, gone in zip(raw(b.column("__text")), b.column("__gone").to_pylist(), strict=True):
            texts.append(kept_text(text, packed(_keep(n := text.count(b"\n") + 1, gone)), n).decode() if gone else text.decode())
        names = [n for n in b.schema.names if n not in ("__text", "__gone")]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string())], [*names, "__kept"])


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The rows of ``docs`` with ``text`` rewritten to the lines kept; other columns as they are (n_chars recounted)."""
    others = [c for c in docs.columns if c != "text"]
    rows = _with_lines(docs, others, min_docs, min_chars)
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.drop("__text", "__gone").dtypes) + ", __kept string"
    out = rows.mapInArrow(_texts, schema).withColumnRenamed("__kept", "text")
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


SQL = f"""
WITH lines AS (
  SELECT doc_id, pos, list_extract(ls, pos) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS p(pos)
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^{SPACE}+', ''), '{SPACE}+$', ''), '{UPPER}', '{LOWER}') AS key FROM lines
), often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(often.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (often.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often ON keyed.key = often.key GROUP BY doc_id
"""
