"""Benchmark decontamination: word pairs as seeds, then Smith-Waterman alignment of the passages they crowd in.

1. An alignment that scores at least S over an item of L words (matches give 2, mismatches and gaps cost 1) has at least
   S - L - 1 pairs of neighbouring words of the item in a passage of at most 3 L - S words: m matches allow 2 m - S
   misses, which cut them into at most 2 m - S + 1 runs. Where that asks for no pair (tiny items), single words do:
   at least S / 2 of them.
2. All pairs (or words) of all items lie in one table. A stretch of a text with as many hits of an item as this bound
   is a passage; none that scores enough is lost, however often the corpus holds the item otherwise.
3. Local alignment over word hashes scores each passage with its item in the task that found it, so no document or item
   gathers rows. The score is divided by that of the whole item, so 1.0 is a verbatim copy and edited copies lose in
   proportion to their edits.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm._spark import BROADCAST_ROWS, NULL_ID, checkpoint, row_key, ship
from gridweave.llm._text import binary, chunks, plain_words, raw, rolling, unpacked, word_hashes

MATCH, MISS = 2, -1


def _item_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = [word_hashes().of(plain_words(t)) for t in raw(b.column("text"))]
        sizes = np.array([len(x) for x in h], np.int64)
        yield pa.RecordBatch.from_arrays([b.column("item_id"), binary(np.concatenate(h), sizes), pa.array(sizes)], ["item_id", "item", "n_item"])


class Index:
    """Items and their seeds: for pairs and for single words, sorted hashes and the items of each."""

    def __init__(self, ids: list[int], items: list[np.ndarray], threshold: float, shortest: int):
        self.ids, self.items = np.array(ids, np.int64), items
        self.short: dict[bytes, list[int]] = {}
        for i, x in enumerate(items):
            if len(x) < shortest:
                self.short.setdefault(x.tobytes(), []).append(i)
        self.shortest = shortest
        size = np.array([len(x) for x in items], np.int64)
        least = np.array([math.ceil(MATCH * threshold * k - 1e-9) for k in size], np.int64)
        pairs = least - size - 1
        self.need = np.where(pairs > 0, pairs, np.maximum(1, -(-least // 2)))
        self.span = np.maximum(1, 3 * size - least)
        self.tables = []
        for n, own in ((1, np.flatnonzero((pairs <= 0) & (size >= shortest))), (2, np.flatnonzero((pairs > 0) & (size >= shortest)))):
            grams = [np.unique(rolling(items[i], n)) for i in own]
            if grams:
                g, owner = np.concatenate(grams), np.repeat(own, [len(x) for x in grams])
                order = np.argsort(g, kind="stable")
                seeds, starts = np.unique(g[order], return_index=True)
                self.tables.append((n, seeds, np.append(starts, len(g)), owner[order]))


def _found(batches: Iterable[pa.RecordBatch], index, threshold: float, many: int = 500_000) -> Iterator[pa.RecordBatch]:
    """(rid, th, item_id, score) of every item that a text holds; at most ``many`` hits or one text's are held at once."""
    x = index.value
    for part, texts in chunks(batches):
        words = [plain_words(t) for t in texts]
        ends = np.cumsum([len(w) for w in words])
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        h = np.concatenate([word_hashes().of(w) for w in words])
        rids, ths = (part.column(c).to_numpy() for c in ("rid", "th"))
        if x.short:
            few = [k for k, w in enumerate(words) if 0 < len(w) < x.shortest]
            whole = [(k, i) for k in few for i in x.short.get(h[begins[k] : ends[k]].tobytes(), ())]
            if whole:
                k, i = np.array(whole).T
                yield pa.RecordBatch.from_arrays([pa.array(rids[k]), pa.array(ths[k]), pa.array(x.ids[i]), pa.array(np.ones(len(k)))], ["rid", "th", "item_id", "score"])
        for n, seeds, starts, owners in x.tables:
            g = rolling(h, n)
            spot = np.minimum(np.searchsorted(seeds, g), len(seeds) - 1)
            at = np.flatnonzero(seeds[spot] == g)
            row = np.searchsorted(ends, at, side="right")
            at, row = (v[at + n <= ends[row]] for v in (at, row))
            degree = np.diff(starts)[spot[at]]
            sums, i = np.cumsum(degree), 0
            while i < len(at):
                j = int(np.searchsorted(sums, (sums[i - 1] if i else 0) + many, side="right"))
                if j < len(at):  # whole texts only
                    j = int(np.searchsorted(row, row[j]))
                    j = j if j > i else int(np.searchsorted(row, row[i], side="right"))
                own, pos, of = degree[i:j], at[i:j], row[i:j]
                inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
                item = owners[np.repeat(starts[spot[pos]], own) + inside]
                pos, of = np.repeat(pos, own), np.repeat(of, own)
                order = np.lexsort((pos, item, of))
                yield from _windows(x, h, n, item[order], pos[order], of[order], begins, ends, rids, ths, threshold)
                i = j


def _windows(x: Index, h, n, item, pos, row, begins, ends, rids, ths, threshold: float) -> Iterator[pa.RecordBatch]:
    """Scores of the stretches where an item's hits are close and many; hits are sorted by row, item and position."""
    last = np.arange(len(pos)) + x.need[item] - 1
    first = np.flatnonzero(last < len(pos))
    last = last[first]
    keep = (row[first] == row[last]) & (item[first] == item[last]) & (pos[last] + n - pos[first] <= x.span[item[first]])
    first, last = first[keep], last[keep]
    if not len(first):
        return
    item, row = item[first], row[first]
    lo, hi = np.maximum(pos[last] + n - x.span[item], begins[row]), np.minimum(pos[first] + x.span[item], ends[row])
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])]))
    stop = np.append(new[1:], len(lo)) - 1
    passages = [h[a:b] for a, b in zip(lo[new], hi[stop], strict=True)]
    item, row = item[new], row[new]
    score = _scores(passages, [x.items[k] for k in item])
    good = score >= threshold
    yield pa.RecordBatch.from_arrays([pa.array(rids[row[good]]), pa.array(ths[row[good]]), pa.array(x.ids[item[good]]), pa.array(score[good])], ["rid", "th", "item_id", "score"])


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """The best local alignment score of each passage with its item, all pairs at once."""
    wide, long = max(map(len, items), default=0), max(map(len, passages), default=0)
    if not wide or not long:
        return np.zeros(len(items), np.int32)
    item = np.zeros((len(items), wide), np.uint64)
    inside = np.zeros((len(items), wide), bool)
    passage = np.zeros((long, len(items)), np.uint64)
    there = np.zeros((long, len(items)), bool)
    for k, (p, i) in enumerate(zip(passages, items, strict=True)):
        item[k, : len(i)], inside[k, : len(i)] = i, True
        passage[: len(p), k], there[: len(p), k] = p, True
    slope = np.arange(wide, dtype=np.int32)  # the cost of a gap that runs along the item
    before = np.zeros((len(items), wide + 1), np.int32)
    best = np.zeros(len(items), np.int32)
    for w, ok in zip(passage, there, strict=True):
        equal = (item == w[:, None]) & inside & ok[:, None]
        now = np.maximum(before[:, :-1] + np.where(equal, MATCH, MISS), before[:, 1:] + MISS)
        now = np.maximum(now, 0)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        before[:, 1:] = now
        best = np.maximum(best, now.max(axis=1))
    return best


def _scores(passages: list[np.ndarray], items: list[np.ndarray], cells: int = 4_000_000) -> np.ndarray:
    size = np.array([len(p) for p in passages])
    order = np.argsort(size, kind="stable")  # alike lengths go together
    score = np.zeros(len(order))
    i = 0
    while i < len(order):
        j, wide = i, 0
        while j < len(order) and (j == i or max(wide, len(items[order[j]])) * (j - i + 1) <= 65_536 and max(wide, len(items[order[j]])) * (j - i + 1) * size[order[j]] <= 16 * cells):
            wide, j = max(wide, len(items[order[j]])), j + 1
        own = order[i:j]
        score[own] = align([passages[k] for k in own], [items[k] for k in own]) / np.array([MATCH * max(1, len(items[k])) for k in own])
        i = j
    return score


def contaminated_rows(docs: DataFrame, items: DataFrame, n: int = 3, threshold: float = 0.6, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """rid, th (see ``row_key``), item_id, score of every row that holds an item; ``contaminated`` tells what is found."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(*row_key(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NULL_ID)).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = checkpoint(items.mapInArrow(_item_words, "item_id long, item binary, n_item long").filter("n_item > 0").withColumn("item_key", F.xxhash64("item_id", "item")).dropDuplicates(["item_key"]))
    # the items go in passes of so many words, each pass over all texts, so what is broadcast has a bound
    passes = max(1, math.ceil((words.agg(F.sum("n_item")).first()[0] or 0) / max(500, 10 * broadcast_rows)))
    out = None
    for k in range(passes):
        table = words.filter(F.pmod("item_key", F.lit(passes)) == k).select("item_id", "item").toArrow()
        values, sizes = unpacked(table["item"], np.uint64)
        index = spark.sparkContext.broadcast(Index(table["item_id"].to_pylist(), [values[e - m : e] for e, m in zip(np.cumsum(sizes), sizes, strict=True)], threshold, n))
        found = docs.mapInArrow(lambda it, index=index: _found(it, index, threshold), "rid long, th long, item_id long, score double")
        out = found if out is None else out.union(found)
    return out


def contaminated(docs: DataFrame, items: DataFrame, n: int = 3, threshold: float = 0.6, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, score of every document that holds an item, verbatim or edited, up to a score of ``threshold``.

    ``docs`` has (doc_id, text), ``items`` (item_id, text). Words are compared in lower case without ASCII punctuation.
    Every alignment with the score is found. Items shorter than ``n`` words, which most texts hold by chance, are found
    where they are all of a text; items without words never are. Rows that repeat a doc_id give one result; a null
    doc_id gives null. Null and empty texts hold nothing. Items that repeat an id and text count once. An empty table on
    either side gives an empty result.
    """
    best = contaminated_rows(docs, items, n, threshold, broadcast_rows).groupBy("rid", "item_id").agg(F.max("score").alias("score"))
    plain = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return best.select(plain("rid").alias("doc_id"), plain("item_id").alias("item_id"), F.round("score", 6).alias("score"))
