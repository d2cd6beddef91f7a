"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, and verified Hamming distances.

A fingerprint is cut into six blocks. Two fingerprints that differ in at most three bits agree on at least three of
the blocks, so both meet under one of the 20 choices of three blocks (about 32 agreed bits, a selective key at any
corpus size). Copies are folded into one fingerprint first. Inside a meeting place only a spanning set of verified
links is written, never all pairs; a place with more than ``limit`` different fingerprints is split again, exactly:
the bits not yet agreed on are cut into six smaller blocks, of which again three must agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm._spark import checkpoint, complete_runs, connected_components, join_skewed, row_key, ship
from gridweave.llm._text import raw

#: Different bits of linked fingerprints.
DISTANCE = 3
BLOCKS = 2 * DISTANCE


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of the shingles of a text; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    parts = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(b" ".join(p), seed) for p in parts), np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        counts += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterable[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t, shingle) for t in raw(b.column("text"))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fp)], ["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, th, fp) for every row; th is that of ``row_key``, fp the fingerprint as a signed long."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key()[1], F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, th long, fp long")


@lru_cache(100_000)
def _split(mask: int) -> tuple[int, ...]:
    """The masks that each add three of six blocks of the bits outside ``mask`` to it, as signed longs."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // BLOCKS for k in range(BLOCKS + 1)]
    blocks = [sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = dict.fromkeys(mask | sum(c) for c in combinations(blocks, BLOCKS - DISTANCE))
    return tuple(m - 2**64 if m >= 2**63 else m for m in masks)


def _spanning(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what distances of at most three connect, one per fingerprint at most."""
    out, left = [], fps
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            head, front = front[0], front[1:]
            near = np.bitwise_count(left ^ head) <= DISTANCE
            if near.any():
                out += [(int(head), int(x)) for x in left[near]]
                front, left = np.concatenate([front, left[near]]), left[~near]
    return out


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("mask", pa.int64())])


def _link(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) inside each run of (mask, key), or (fingerprint, null, finer mask) for runs over ``limit``.

    Runs over ``limit`` are passed on as they stream by; a task holds no more than a table of rows.
    """
    cut = None  # the run whose pieces were passed on
    for t in complete_runs(batches, ["mask", "key"], max(65_536, limit + 1), pieces=True):
        mask, key, fp = (t[c].to_numpy() for c in ("mask", "key", "fp"))
        starts = np.concatenate([[0], np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1, [len(fp)]])
        sizes = np.diff(starts)
        rest = cut == (mask[0], key[0])
        whole = np.ones(len(sizes), bool)
        whole[0] = not rest
        two = starts[:-1][(sizes == 2) & whole]
        near = np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= DISTANCE
        a, b, finer = [fp[two][near]], [fp[two + 1][near]], []
        for i in np.flatnonzero((sizes > 2) | ~whole):
            own = fp[starts[i] : starts[i + 1]]
            agreed = int(mask[starts[i]]) & (2**64 - 1)
            if whole[i] and len(own) <= limit or agreed.bit_count() >= 56:  # eight free bits leave 256 values
                links = np.array(_spanning(own.view(np.uint64)), np.uint64).reshape(-1, 2)
                a.append(links[:, 0].view(np.int64) if len(links) else own[:0])
                b.append(np.ascontiguousarray(links[:, 1]).view(np.int64) if len(links) else own[:0])
            else:
                finer += [(own, m) for m in _split(agreed)]
        cut = (mask[-1], key[-1]) if len(sizes) == 1 and (rest or sizes[0] > limit) else None
        a, b = (np.concatenate([np.ascontiguousarray(x) for x in v]) for v in (a, b))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], schema=_LINKS)
        for own, m in finer:
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(own), pa.int64()), pa.array(np.full(len(own), m))], schema=_LINKS)


def links(fps: DataFrame, limit: int = 2048) -> DataFrame:
    """Edges (a, b) between the different fingerprints ``fp``: every two within three bits end up connected."""
    out = None
    todo = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in _split(0)])).alias("mask"))
    while True:
        met = todo.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        found = checkpoint(met.mapInArrow(lambda it: _link(it, limit), "a long, b long, mask long"))
        edges = found.filter("mask is null").select("a", "b")
        out = edges if out is None else out.union(edges)
        todo = found.filter("mask is not null").select(F.col("a").alias("fp"), "mask").distinct()
        if todo.isEmpty():
            return out.distinct()


def _of_components(each: DataFrame, folded: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``each`` with component_id and stays; ``folded`` has ``first`` and n for every ``key``, ``edges`` link keys.

    Of a component the rows with the smallest doc_id, and of these with the smallest th, stay; nulls come last.
    """
    joined = connected_components(edges).withColumnsRenamed({"node": key})
    linked = checkpoint(folded.select(key, "first").join(joined, key).select(key, "first", "component"))
    of = linked.groupBy("component").agg(F.min("first").alias("least"))
    named = checkpoint(folded.select(key, "first", "n").join(linked.join(of, "component").select(key, "least"), key, "left").select(key, "n", F.coalesce("least", "first").alias("least")))
    total = each.count()
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("th") == F.col("least.th"))
    return join_skewed(each, named, key, total).select("doc_id", "th", key, F.col("least.doc_id").alias("component_id"), stays.alias("stays"))


def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")


def groups(docs: DataFrame, shingle: int = 3, limit: int = 2048) -> DataFrame:
    """doc_id, th, fp, component_id, stays for every row; ``near_duplicates`` tells how."""
    each = checkpoint(fingerprints(docs, shingle))
    folded = checkpoint(each.groupBy("fp").agg(_first(), F.count("*").alias("n")))
    return _of_components(each, folded, links(folded.select("fp"), limit), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = 2048) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of three bits or fewer).

    Texts without words have fingerprint zero and are linked like any other. A null doc_id keeps its row; a component
    of nothing but null ids has a null id. Repeated rows give repeated rows. An empty table gives an empty result.
    """
    return groups(docs, shingle, limit).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
