"""Substring de-duplication: repeated word windows by prefix-partitioned suffix trees.

The suffixes of all texts are dealt into subtrees by their first words. They are thinned without loss: of every window
the 8-gram with the smallest hash (the leftmost of equals) is the *anchor*, a function of the window's words alone, so
equal windows have equal anchors at equal offsets. Only suffixes that begin at an anchor are kept; each brings along the
words in front of it that its windows need, and so stands for all windows around its anchor.

1. Prefixes (the anchors' 8 words) are counted. One met once has no internal node below it and is left out, by a bit
   filter of fixed size (no false negatives).
2. A suffix goes to the subtree of its prefix. A prefix whose subtree would not fit a task is lengthened to all words of
   a window: each window around such an anchor becomes a suffix of its own, dealt by 20 words; of equal ones in a chunk
   of texts all but the first are marked on the spot. A window met so often that even that subtree is too large is
   dealt by document too; the firsts of each part then meet once more.
3. A task builds its subtrees level by level from the words themselves: suffixes share a node of depth d if their first d
   words are equal, and left sides are told apart in the same way. A node of depth d to the right whose suffixes agree on
   the ``window - d`` words to the left is an internal node of a repeat of a whole window; the runs of windows that a
   suffix has such nodes for are its maximal repeats, as far as its anchor reaches. Of the leaves below a node the first
   by document and position is kept and the others are marked.
4. The marks of each document, as (start, bit mask), are joined back to its text.

Hashes only deal suffixes to groups. Nodes compare words, so results hold whatever collides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm._spark import checkpoint, complete_runs, filter_blocks, filter_bytes, in_filter, row_key, ship
from gridweave.llm._text import WORD, chunks, mix, raw, rolling, sliding_min, word_hashes

LOG2_BITS = 27
#: Words of a prefix, and suffixes of one prefix from which it is lengthened (more on inputs of over 2**32 anchors, so
#: that the list of these prefixes has 2**20 entries at most).
PREFIX = 8
HEAVY = 4096
LISTED = 1 << 20
#: The salt of rows that are marks already.
DONE = -1


class Anchors:
    """The anchors of some texts. For each: hash of its prefix, row, place of its first window, number of windows, and
    words of the first window in front of it. Places are among all words of all texts."""

    def __init__(self, texts: list[bytes], window: int):
        self.words = [t.split() for t in texts]
        counts = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(counts)
        self.begins = self.ends - counts
        hashes = word_hashes()
        h = np.concatenate([hashes.of(w) for w in self.words]) if self.words else np.zeros(0, np.uint64)
        gram = min(PREFIX, window)
        self.full = rolling(h, window)
        small = rolling(h, gram)
        if not len(self.full):
            self.h = np.zeros(0, np.uint64)
            self.row = self.at = self.sizes = self.left = np.zeros(0, np.int64)
            return
        low = sliding_min(small, window - gram + 1)
        to = np.zeros(len(self.full), np.int64)
        for j in range(window - gram, -1, -1):
            to = np.where(small[j : j + len(self.full)] == low[: len(self.full)], j, to)
        row = np.repeat(np.arange(len(self.words)), counts)[: len(self.full)]
        valid = np.flatnonzero(np.arange(len(self.full)) + window <= self.ends[row])
        anchor, row = valid + to[valid], row[valid]
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])) if len(valid) else valid
        self.h, self.row, self.at = small[anchor[first]], row[first], valid[first]
        self.sizes, self.left = np.diff(np.concatenate([first, [len(valid)]])), to[valid[first]]

    def keep(self, these: np.ndarray) -> None:
        self.h, self.row, self.at, self.sizes, self.left = (x[these] for x in (self.h, self.row, self.at, self.sizes, self.left))


def _count(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for _, texts in chunks(batches, limit=8_000_000):
        h, n = np.unique(Anchors(texts, window).h, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])


#: h, salt: the subtree. start: word of the document that the first window begins at. shape: windows * 256 + words in
#: front of the anchor. words: from the first window's start to the last one's end, joined by spaces.
_SUFFIX = "h long, salt long, rid long, th long, start int, shape int, words binary"
_SUFFIXES = pa.schema([("h", pa.int64()), ("salt", pa.int64()), ("rid", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("shape", pa.int32()), ("words", pa.binary())])


def _suffixes(batches: Iterable[pa.RecordBatch], window: int, bits, heavy) -> Iterator[pa.RecordBatch]:
    bits, (often, parts) = bits.value, heavy.value
    for part, texts in chunks(batches):
        a = Anchors(texts, window)
        a.keep(in_filter(bits, a.h, LOG2_BITS))
        flat = [w for ws in a.words for w in ws]
        size = np.fromiter(map(len, flat), np.int64, len(flat))
        stop = np.cumsum(size + 1) - 1
        joined = b" ".join(flat)
        rids, ths = (part.column(c).to_numpy() for c in ("rid", "th"))

        def rows(h, salt, row, at, sizes, left, size=size, stop=stop, joined=joined, begins=a.begins, rids=rids, ths=ths):
            words = [joined[x:y] for x, y in zip((stop[at] - size[at]).tolist(), stop[at + sizes + window - 2].tolist(), strict=True)]
            columns = h.view(np.int64), salt, rids[row], ths[row], (at - begins[row]).astype(np.int32), (sizes * 256 + left).astype(np.int32), words
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SUFFIXES.types, strict=True)], schema=_SUFFIXES)

        long = np.zeros(len(a.h), bool)
        if len(often) and len(a.h):
            k = np.minimum(np.searchsorted(often, a.h), len(often) - 1)
            long = often[k] == a.h
        short = np.flatnonzero(~long)
        yield rows(a.h[short], np.zeros(len(short), np.int64), a.row[short], a.at[short], a.sizes[short], a.left[short])
        if long.any():
            i = np.flatnonzero(long)
            step = np.arange(a.sizes[i].sum()) - np.repeat(np.cumsum(a.sizes[i]) - a.sizes[i], a.sizes[i])
            i = np.repeat(i, a.sizes[i])
            at, row, left = a.at[i] + step, a.row[i], a.left[i] - step
            salt = 1 + (mix(rids[row].view(np.uint64) ^ ths[row].view(np.uint64)) % parts[k[i]]).astype(np.int64)
            # of equal windows in these texts only the first needs to meet others
            place = at - a.begins[row]
            order = np.lexsort((place, ths[row], rids[row], a.full[at]))
            lead = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(a.full[at[order]]) != 0]), np.arange(len(at)), 0))
            one, other = at[order], at[order[lead]]
            x, y, u, v = ((stop[p] - size[p]).tolist() if q == 0 else stop[p + window - 1].tolist() for p, q in ((one, 0), (one, 1), (other, 0), (other, 1)))
            equal = np.array([j != f and joined[b:c] == joined[d:e] for j, (f, b, c, d, e) in enumerate(zip(lead.tolist(), x, y, u, v, strict=True))], bool)
            stay = np.sort(order[~equal])
            yield rows(a.full[at[stay]], salt[stay], row[stay], at[stay], np.ones(len(stay), np.int64), left[stay])
            again, f = order[equal], order[lead[equal]]
            again = again[(rids[row[again]] != rids[row[f]]) | (ths[row[again]] != ths[row[f]]) | (place[again] != place[f])]
            yield _marked(rids[row[again]], ths[row[again]], place[again], min(window, 31))


def _marked(rid: np.ndarray, th: np.ndarray, place: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows that say where windows occur again: bit j of the shape is the window at start + j. Their salt is DONE."""
    order = np.lexsort((place, th, rid))
    rid, th, place = rid[order], th[order], place[order]
    block = place // bits
    new = np.concatenate([[True], (rid[1:] != rid[:-1]) | (th[1:] != th[:-1]) | (block[1:] != block[:-1])])[: len(rid)]
    at = np.flatnonzero(new)
    shape = np.bitwise_or.reduceat(np.int64(1) << place % bits, at) if len(at) else at
    rid, th, block = rid[at], th[at], block[at]
    columns = mix(rid.view(np.uint64) ^ block.astype(np.uint64)).view(np.int64), np.full(len(at), DONE), rid, th, block * bits, shape, [None] * len(at)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SUFFIXES.types, strict=True)], schema=_SUFFIXES)


def _nodes(above: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The nodes one level down: equal where the node above and the next word are."""
    return np.unique(above * (int(word.max(initial=0)) + 1) + word, return_inverse=True)[1]


def _spread(words: pa.Array, left: np.ndarray, reach: int, gram: int) -> np.ndarray:
    """Numbers of the words, one column a suffix, so that all anchors begin in row ``reach``; 0 where there is none."""
    lists = pc.split_pattern(words, " ")
    counts = np.diff(lists.offsets.to_numpy())
    codes = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    of = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros((2 * reach + gram, len(counts)), np.int64)
    out[np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts) + (reach - left)[of], of] = codes
    return out


_MARK = "rid long, th long, start int, mask long, h long, shape int, words binary"
_MARKS = pa.schema([("rid", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("mask", pa.int64()), ("h", pa.int64()), ("shape", pa.int32()), ("words", pa.binary())])


def _subtrees(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Marks of the windows that occur earlier in their subtree, and the first windows of subtrees that are split by document.

    Rows come sorted by subtree, document and position; a run of subtrees is held at a time.
    """
    gram = min(PREFIX, window)
    reach = window - gram
    for t in complete_runs(batches, ["h", "salt"], 32_768):
        done = pc.equal(t["salt"], DONE)
        if pc.any(done).as_py():
            d = t.filter(done)
            yield from pa.Table.from_arrays([d["rid"], d["th"], d["start"], d["shape"].cast(pa.int64()), *(pa.nulls(d.num_rows, f.type) for f in list(_MARKS)[4:])], schema=_MARKS).to_batches()
            t = t.filter(pc.invert(done))
        if not t.num_rows:
            continue
        h, salt = t["h"].to_numpy(), t["salt"].to_numpy()
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])])
        alone = np.diff(np.append(np.flatnonzero(new), len(h))) == 1
        keep = ~alone[np.cumsum(new) - 1] | (salt > 0)
        t = t.filter(pa.array(keep)).combine_chunks()
        if not t.num_rows:
            continue
        new = new[keep]
        h, salt, rid, th, start, shape = (t[c].to_numpy() for c in ("h", "salt", "rid", "th", "start", "shape"))
        words = t["words"].chunk(0) if isinstance(t["words"], pa.ChunkedArray) else t["words"]
        many, left = (shape >> 8).astype(np.int64), (shape & 255).astype(np.int64)
        w = _spread(words, left, reach, gram)
        root = np.cumsum(new) - 1
        prefix = w[reach : reach + gram]
        if (prefix != prefix[:, np.flatnonzero(new)[root]]).any():  # prefixes that only share their hash
            for word in prefix:
                root = _nodes(root, word)
        right, before = [root], [np.zeros(len(h), np.int64)]
        for d in range(reach):
            right.append(_nodes(right[-1], w[reach + gram + d]))
            before.append(_nodes(before[-1], w[reach - 1 - d]))
        mask, first = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        for d in range(reach + 1):  # windows with d words in front of the anchor
            own = np.flatnonzero((left >= d) & (left - many < d))
            if not len(own):
                continue
            node = right[reach - d][own] * len(h) + before[d][own]
            order = np.argsort(node, kind="stable")
            node, r = node[order], own[order]
            lead = np.concatenate([[True], node[1:] != node[:-1]])
            f = r[np.maximum.accumulate(np.where(lead, np.arange(len(r)), 0))]
            later = r[(rid[r] != rid[f]) | (th[r] != th[f]) | (start[r] + left[r] != start[f] + left[f])]  # the same place twice is a repeated row
            mask[later] |= np.int64(1) << (left[later] - d)
            first[r[lead]] = True
        some = np.flatnonzero(mask)
        yield pa.RecordBatch.from_arrays([pa.array(rid[some]), pa.array(th[some]), pa.array(start[some]), pa.array(mask[some]), *(pa.nulls(len(some), f.type) for f in list(_MARKS)[4:])], schema=_MARKS)
        if (salt > 0).any():
            some = np.flatnonzero(first & (salt > 0))
            yield pa.RecordBatch.from_arrays([pa.array(rid[some]), pa.array(th[some]), pa.array(start[some]), pa.nulls(len(some), pa.int64()), pa.array(h[some]), pa.array(shape[some]), words.take(pa.array(some))], schema=_MARKS)


def _met(suffixes: DataFrame, window: int, *deal: str) -> DataFrame:
    return suffixes.repartition(*deal).sortWithinPartitions("h", "salt", "rid", "th", "start").mapInArrow(lambda it: _subtrees(it, window), _MARK)


def repeated_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """(rid, th, start, mask): bit j of the mask marks the window at word start + j, which also occurs earlier."""
    if not 0 < window < 64:
        raise ValueError(f"a window has 1 to 63 words, not {window}")
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(*row_key(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = rows.select("text").mapInArrow(lambda it: _count(it, window), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    counted = checkpoint(counted)
    limit = max(HEAVY, int(counted.agg(F.sum("n")).first()[0] or 0) // LISTED)
    often = counted.filter(F.col("n") > limit).toArrow()  # fewer than LISTED by the limit
    h, n = (often[c].to_numpy() for c in ("h", "n"))
    order = np.argsort(h.view(np.uint64))
    heavy = spark.sparkContext.broadcast((h.view(np.uint64)[order], -(-n[order] // limit).astype(np.uint64)))
    bits = spark.sparkContext.broadcast(filter_bytes(filter_blocks(counted, F.col("h"), LOG2_BITS), LOG2_BITS))
    marks = _met(rows.mapInArrow(lambda it: _suffixes(it, window, bits, heavy), _SUFFIX), window, "h", "salt")
    if not len(h):
        return marks.select("rid", "th", "start", "mask")
    marks = checkpoint(marks)
    # one window has a first for each of its prefix's parts at most
    firsts = marks.filter("h is not null").select("h", F.lit(0).cast("long").alias("salt"), "rid", "th", "start", "shape", "words")
    return marks.filter("h is null").union(_met(firsts, window, "h").filter("h is null")).select("rid", "th", "start", "mask")


def _kept(words: list[bytes], marks: list[dict] | None, window: int) -> list[bytes]:
    if not marks:
        return words
    start, mask = (np.array([m[k] for m in marks], np.int64) for k in ("start", "mask"))
    edge = np.zeros(len(words) + 1, np.int64)
    for j in range(window):
        at = start[mask >> j & 1 == 1] + j
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _apply(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], []]
        for text, marks in zip(raw(b.column("text")), b.column("marks").to_pylist(), strict=True):
            words = text.split()
            kept = _kept(words, marks, window)
            text = b" ".join(kept)
            for v, x in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text), strict=True):
                v.append(x)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def drop_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by one space) for every row.

    Words are what ASCII white space separates, unchanged. A word goes if a window of ``window`` words over it has a
    word sequence that also starts earlier: in a smaller doc_id, or earlier in the document. Windows are judged on the
    input. Different rows of one doc_id are ordered by a hash of their texts; equal rows are one place, so none is lost
    through its own repetition. Texts shorter than a window, empty ones and nulls stay as they are. An empty table
    gives an empty result. Windows are compared word by word.
    """
    marks = repeated_windows(docs, window).groupBy("rid", "th").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *row_key())
    joined = rows.join(marks.hint("shuffle_hash"), ["rid", "th"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(lambda it: _apply(it, window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
wins AS (SELECT doc_id, p, sha256(array_to_string(list_slice(w, p, p + 19), ' ')) AS s FROM d, unnest(range(1, len(w) - 18)) AS r(p)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM wins) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p + j AS p FROM later, unnest(range(0, 20)) AS o(j)),
words AS (SELECT doc_id, p, list_extract(w, p) AS word FROM d, unnest(range(1, len(w) + 1)) AS r(p))
SELECT d.doc_id, any_value(len(d.w)) AS n_words, count(gone.p) AS n_removed,
  sha256(coalesce(string_agg(words.word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p
GROUP BY d.doc_id
"""
