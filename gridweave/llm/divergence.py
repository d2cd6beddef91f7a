"""How the sources of a language differ in their terms: pairs of sources, and terms that a source has more of.

A term is a run of letters (ASCII letters, lower-cased, and all other characters from U+0080 on). Each language keeps the
terms that at least ``MIN_DOCS`` of its documents hold. A source gives each kept term the share
p = 1 + floor(10^9 (count + 5) / (N + 5 V)), which is added to whole numbers only.

Pairs are compared on run-length columns. The kept terms of a language are put in an order that brings equal counts
together: each term's row of counts, sources with the fewest occurrences first, is a key, and equal keys are one row with
a length. The rows are split into ranges (segments). Within a segment, each source's column of counts is run-length
encoded; a pair of columns is met at the union of its run boundaries, and each met run adds |p - q| times its length. The
columns of a segment are dealt into blocks of sources, so a task holds two blocks, whatever a language's number of sources.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm._spark import checkpoint, ship
from gridweave.llm._text import LOWER, UPPER, binary, chunks, unpacked

MIN_DOCS = 30
#: What is added to each count, and the whole that shares are parts of (values of the contract).
SMOOTH, WHOLE = 5, 1_000_000_000
TOP = 50
#: Sources of one block.
BLOCK = 64
#: (lang, source, term) counts that a task holds before it gives them on.
HELD = 400_000
_LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the task's documents, in parts."""
    n: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def parts() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in n.items():
            terms, seen = list(counts), docs[lang, source]
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([seen[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        n.clear()
        docs.clear()

    for part, texts in chunks(batches):
        for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), texts, strict=True):
            words = text.translate(_LETTERS).split()
            n[lang, source].update(words)
            docs[lang, source].update(set(words))
        if sum(map(len, n.values())) > HELD:
            yield from parts()
    yield from parts()


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (n + 5 v)) in whole numbers; ``n`` + 5 ``v`` is above 0."""
    exact = [c.cast("decimal(18,0)") for c in (count + SMOOTH, n + SMOOTH * v)]
    return F.call_function("div", exact[0] * F.lit(WHOLE).cast("decimal(10,0)"), exact[1]) + 1


class Audit:
    """The tables of one audit: ``groups`` (lang, source, n, v, lang_n), ``terms`` (lang, term, total, by_source)."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS):
        ship(docs.sparkSession)
        own = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
        counted = docs.select(*own).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
        cells = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        terms = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by_source"))
        self.terms = checkpoint(terms.filter(F.col("docs") >= min_docs).select("lang", "term", "total", "by_source"))
        of_lang = self.terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
        of_group = self.cells().groupBy("lang", "source").agg(F.sum("n").alias("n"))
        there = docs.select(*own[1:]).distinct()
        zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n", "v", "lang_n")]
        self.groups = checkpoint(there.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", *zero))

    def cells(self) -> DataFrame:
        """(lang, term, total, source, n) of kept terms and the sources that have them."""
        return self.terms.select("lang", "term", "total", F.inline("by_source"))

    def columns(self) -> DataFrame:
        """(lang, segment, rows, source, starts, counts): run-length columns of each segment, for sources that occur in it;
        ``starts`` (long) and ``counts`` (long) are binary, ``rows`` the segment's number of terms."""
        sized = self.cells().join(self.groups.select("lang", "source", F.col("n").alias("size")), ["lang", "source"])
        keys = sized.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("size", "source", "n"))).alias("key"))
        rows = keys.groupBy("lang", "key").agg(F.count("*").alias("length"))  # equal counts everywhere: one row
        ordered = rows.repartitionByRange("lang", "key").sortWithinPartitions("lang", "key")
        flat = ordered.select("lang", F.spark_partition_id().alias("segment"), "length", F.col("key.source").alias("sources"), F.col("key.n").alias("counts"))
        return flat.mapInArrow(_encode, "lang string, segment int, rows long, source string, starts binary, counts binary")

    def pairs(self) -> DataFrame:
        """(lang, source, item, value) for each source and each other one of its language."""
        coded = checkpoint(self.columns())
        segments = coded.select("lang", "segment", "rows").distinct()
        blocks = F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("lang")) / BLOCK))
        dealt = checkpoint(self.groups.select("lang", "source", "n", "v", blocks.cast("int").alias("blocks")).withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int")))
        full = dealt.join(segments, "lang").join(coded.drop("rows"), ["lang", "segment", "source"], "left")
        both = full.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = both.select("lang", "segment", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "source", "n", "v", "rows", "starts", "counts")
        met = placed.groupBy("lang", "segment", "low", "high").applyInArrow(_meet, "lang string, a string, b string, value long")
        summed = met.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        none = dealt.filter("v = 0").select("lang", "source")
        alike = none.join(none.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
        way = [F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("a", "b"), ("b", "a"))]
        return summed.select("lang", F.inline(F.array(*way)), "value").select("lang", "source", "item", "value").unionByName(alike)

    def over(self) -> DataFrame:
        """(lang, source, item, value) for each term that a source has more of than its language."""
        got = self.cells().withColumnRenamed("n", "count").join(self.groups, ["lang", "source"])
        more = share(F.col("count"), F.col("n"), F.col("v")) - share(F.col("total"), F.col("lang_n"), F.col("v"))
        return got.select("lang", "source", F.col("term").alias("item"), more.alias("value")).filter("value > 0")


def _encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of counts to columns of runs. A change of language or segment ends a segment."""
    runs: dict[str, tuple[list[int], list[int]]] = {}
    last: dict[str, tuple[int, int]] = {}  # each source's count and the row after its last one
    key, at = None, 0

    def columns() -> Iterator[pa.RecordBatch]:
        for source, (_, end) in last.items():
            if end < at:
                runs[source][0].append(end)
                runs[source][1].append(0)
        if runs:
            several = [pa.array([v] * len(runs), t) for v, t in ((key[0], pa.string()), (key[1], pa.int32()), (at, pa.int64()))]
            made = [binary(np.array([x for r in runs.values() for x in r[i]], np.int64), np.array([len(r[i]) for r in runs.values()])) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*several, pa.array(list(runs)), *made], ["lang", "segment", "rows", "source", "starts", "counts"])
        runs.clear()
        last.clear()

    for batch in batches:
        for lang, segment, length, sources, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (lang, segment):
                yield from columns()
                key, at = (lang, segment), 0
            for source, n in zip(sources, counts, strict=True):
                count, end = last.get(source, (0, 0))
                starts, values = runs.setdefault(source, ([], []))
                if end < at:  # rows without it in between
                    starts.append(end)
                    values.append(0)
                if end < at or n != count or not starts:
                    starts.append(at)
                    values.append(n)
                last[source] = (n, at + length)
            at += length
    yield from columns()


def _meet(group: pa.Table) -> pa.Table:
    """The part of each pair's value that a segment adds, for pairs between its two blocks (or within its one)."""
    lang, low, high, rows = group["lang"][0].as_py(), group["low"][0].as_py(), group["high"][0].as_py(), group["rows"][0].as_py()
    names, block = group["source"].to_pylist(), group["block"].to_pylist()
    columns = []
    for n, v, starts, counts in zip(*(group[c].to_pylist() for c in ("n", "v", "starts", "counts")), strict=True):
        starts, counts = (np.frombuffer(x, np.int64) for x in (starts, counts)) if starts is not None else (np.zeros(1, np.int64),) * 2
        different, at = np.unique(counts, return_inverse=True)
        total = n + SMOOTH * v
        columns.append((starts, np.array([1 + WHOLE * (c + SMOOTH) // total for c in different.tolist()], np.int64)[at]))
    order = sorted(range(len(names)), key=names.__getitem__)
    found: list[tuple[str, str, int]] = []
    for i, x in enumerate(order):
        for y in order[i + 1 :]:
            if low != high and block[x] == block[y]:
                continue
            (s, p), (t, q) = columns[x], columns[y]
            cuts = np.union1d(s, t)
            apart = np.abs(p[np.searchsorted(s, cuts, "right") - 1] - q[np.searchsorted(t, cuts, "right") - 1])
            found.append((names[x], names[y], int(apart @ np.diff(np.append(cuts, rows)))))
    a, b, value = zip(*found, strict=True) if found else ((), (), ())
    return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` has each other source of the language, ``term`` the ``top`` terms that
    the source has more of; value descending, then item.

    A null text, lang or source is empty. A row is a document, repeated ones too. A group without kept terms takes part
    with counts of 0; a language without kept terms has pairs of value 0. An empty table gives an empty result.
    """
    made = Audit(docs, min_docs)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pair = made.pairs().withColumn("rank", rank).withColumn("part", F.lit("pair"))
    term = made.over().withColumn("rank", rank).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pair.unionByName(term).select("lang", "source", "part", "item", "value", "rank")


SQL = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS s FROM documents),
w AS (SELECT row_number() OVER () AS id, lang, source, regexp_extract_all(s, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM d),
u AS (SELECT id, lang, source, unnest(terms) AS term FROM w),
kept AS (SELECT lang, term, count(*)::BIGINT AS total FROM u GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*)::BIGINT AS n FROM u SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT s.lang, s.source, kept.term, kept.total, coalesce(c.n, 0) AS count, 1 + {WHOLE}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH}) // (s.n + {SMOOTH} * v.v)::HUGEINT AS p
  FROM s JOIN kept ON kept.lang = s.lang JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) AS t ON t.lang = a.lang AND t.source = a.source AND t.item = b.source),
term AS (SELECT p.lang, source, term AS item, p - (1 + {WHOLE}::HUGEINT * (total + {SMOOTH}) // (v.n + {SMOOTH} * v.v)::HUGEINT) AS value FROM p JOIN v ON v.lang = p.lang WHERE count > 0),
ranked AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term WHERE value > 0)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM ranked) WHERE part = 'pair' OR rank <= {TOP}
"""
