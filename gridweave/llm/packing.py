"""Packing of token pieces into windows by Karmarkar-Karp multiway differencing.

Every text becomes ids (the tokenizer's, then ``END``) in one pass and is cut at multiples of the capacity. A piece that fills a
window is one. The others are dealt into groups of some ``GROUP_TOKENS`` ids by a hash of their row's number, so that no id,
source or repeated row makes a group larger. In a group, each piece begins as a partial partition into k windows, all but
one empty; the two partial partitions with the largest imbalance are merged again and again, the fullest window of one
with the emptiest of the other, until one is left. k begins at what the ids need; as long as a window is over the
capacity, it rises by one.

Ids come from the tokenizers library's model, once a different piece of text; texts are normalised and split here as the
file says (files that say otherwise are refused).
"""

from __future__ import annotations

import gc
import heapq
import json
import os
import re
import unicodedata
import zlib
from bisect import bisect
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm import bpe
from gridweave.llm._spark import checkpoint, ship
from gridweave.llm._text import chunks

CAPACITY = 4096
#: The id behind every text.
END = 2
#: Ids and pieces of a group, by which the number of groups follows the input.
GROUP_TOKENS, GROUP_PIECES = 1 << 22, 50_000
#: Entries and characters of a worker's store of encoded parts; clearing it costs time only.
STORE, STORE_CHARS = 800_000, 10_000_000
#: Parts that go to the library in one text.
TOGETHER = 200
#: The split pattern of word_bpe_49k.json, and what it says about lower-case ASCII texts (fixed values).
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
ASCII_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\t-\\r a-z0-9]+")


class TextIds:
    """Ids of texts as arrays; words and their parts seen lately are kept, as bytes, four for an id."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        said = json.loads(spec)
        vocabulary = bpe.Vocabulary(said)
        self.model = Tokenizer.from_str(json.dumps(said | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None}))
        self.special = {t: np.uint32(i).tobytes() for t, i in vocabulary.special.items()}
        named = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.between = re.compile(f"({named})") if named else None
        self.odd = f"{named}|[\\x1c-\\x1f]" if named else "[\\x1c-\\x1f]"  # the separators are white space to Arrow alone
        self.pattern, self.quick = vocabulary.pattern, vocabulary.pattern.pattern == SPLIT
        self.symbols = bpe.byte_symbols()
        self._clear()

    def _clear(self) -> None:
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}
        self.chars = 0

    def _parts(self, word: str) -> list[str]:
        if self.quick and word.isascii():
            if word.isalpha():
                return [word.lower()]
            return [word[:-1].lower(), word[-1]] if word[:-1].isalpha() else ASCII_SPLIT.findall(word.lower())
        word = unicodedata.normalize("NFC", word)
        return self.pattern.findall(word.lower() if "Σ" not in word else "".join([c.lower() for c in word]))  # no final sigma

    def _learn(self, words: list[str]) -> None:
        if len(self.words) > STORE or self.chars > STORE_CHARS:
            self._clear()
        known, parts, symbols = self.words, self.parts, self.symbols
        split = {w: self._parts(w) for w in words if w not in known}
        if new := list({p for ps in split.values() for p in ps if p not in parts}):
            written = [p if p.isascii() and p.isprintable() else "".join([symbols[b] for b in p.encode()]) for p in new]
            texts = [" ".join(written[i : i + TOGETHER]) for i in range(0, len(new), TOGETHER)]
            for i, encoded in zip(range(0, len(new), TOGETHER), self.model.encode_batch(texts, add_special_tokens=False), strict=True):
                raw = np.array(encoded.ids, np.uint32).tobytes()
                some = new[i : i + TOGETHER]
                cut = (np.searchsorted(np.array(encoded.word_ids, np.int64), np.arange(len(some) + 1)) * 4).tolist()
                parts.update({p: raw[i:j] for p, i, j in zip(some, cut, cut[1:], strict=False)})
        for w, ps in split.items():
            known[w] = parts[ps[0]] if len(ps) == 1 else b"".join([parts[p] for p in ps])
        self.chars += sum(map(len, split))

    def _odd(self, text: str) -> bytes:
        """A text that holds special tokens or separators, run by run."""
        runs = [(i % 2, [t] if i % 2 else bpe._UNSPACED.findall(t)) for i, t in enumerate(self.between.split(text) if self.between else [text])]
        self._learn([w for special, ws in runs if not special for w in ws])
        return b"".join([self.special[w] if special else self.words[w] for special, ws in runs for w in ws])

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; texts are not null. Different words are looked up once a call."""
        odd = pc.match_substring_regex(texts, self.odd)
        if some := pc.any(odd).as_py():
            plain = pc.if_else(odd, "", texts)
        split = pc.utf8_split_whitespace(plain if some else texts)
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self._learn(words)
        ids = [self.words[w] for w in words]
        pool, size = np.frombuffer(b"".join(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        lengths, starts = size[at], (np.cumsum(size) - size)[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out = pool[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])]
        cuts = ends[bounds - bounds[0]]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            yield np.frombuffer(self._odd(texts[i].as_py()), np.uint32) if some and odd[i].as_py() else out[a:b]


@lru_cache(2)
def _ids(spec: str) -> TextIds:
    return TextIds(spec)


def _cut(batches: Iterable[pa.RecordBatch], spec, capacity: int, ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = _ids(spec.value)
    gc.disable()  # the stores hold no cycles
    try:
        yield from _pieces(batches, encoder, capacity, ids)
    finally:
        gc.enable()


def _pieces(batches: Iterable[pa.RecordBatch], encoder: TextIds, capacity: int, ids: bool) -> Iterator[pa.RecordBatch]:
    end = np.uint32(END).tobytes()
    for part, _ in chunks(batches, "text", 4_000_000):
        rows: list[tuple] = []
        for doc, own in zip(part.column("doc_id").to_pylist(), encoder.of(part.column("text")), strict=True):
            raw = own.tobytes() + end
            view, n = memoryview(raw), len(raw) // 4
            for start in range(0, n, capacity):
                own = view[4 * start : 4 * (start + capacity)]
                rows.append((doc, start, len(own) // 4, zlib.crc32(own), n, bytes(own) if ids else None))
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in columns[:5]]
        yield pa.RecordBatch.from_arrays(arrays + [pa.array(columns[5], pa.binary())] * ids, PIECE[: 5 + ids])


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, from 0 to k - 1, of each of the sizes: partial partitions merged by largest imbalance first.

    A partial partition is its windows that hold something, fullest first. One that meets a single piece gets it in an
    empty window or in its emptiest one, which needs no sorting; so only merges of larger ones cost their length.
    """
    n = len(sizes)
    if k == 1:
        return np.zeros(n, np.int64)
    heap = [(-int(s), i, [int(s)], [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    left, right, turn = [], [], n  # a node joins two; the first n are the pieces
    while len(heap) > 1:
        _, _, a, at_a = heapq.heappop(heap)
        _, _, b, at_b = heapq.heappop(heap)
        if len(a) == 1:
            a, at_a, b, at_b = b, at_b, a, at_a
        if len(b) == 1 and len(a) < k:
            at = len(a) if b[0] <= a[-1] else bisect(a, -b[0], key=lambda x: -x)
            a.insert(at, b[0])
            at_a.insert(at, at_b[0])
            sums, nodes = a, at_a
        elif len(b) == 1:
            x, joined = a.pop() + b[0], n + len(left)
            left.append(at_a.pop())
            right.append(at_b[0])
            at = bisect(a, -x, key=lambda y: -y)
            a.insert(at, x)
            at_a.insert(at, joined)
            sums, nodes = a, at_a
        else:
            alone = min(len(a), k - len(b))  # windows of a that meet empty ones
            both = len(a) - alone
            b, at_b = b[::-1], at_b[::-1]
            joined = list(range(n + len(left), n + len(left) + both))
            left += at_a[alone:]
            right += at_b[:both]
            sums = np.array([*a[:alone], *(x + y for x, y in zip(a[alone:], b, strict=False)), *b[both:]], np.int64)
            order = np.argsort(-sums, kind="stable")
            nodes = np.array([*at_a[:alone], *joined, *at_b[both:]], np.int64)[order].tolist()
            sums = sums[order].tolist()
        turn += 1
        heapq.heappush(heap, (-(sums[0] - (sums[-1] if len(sums) == k else 0)), turn, sums, nodes))
    where = [0] * (n + len(left))
    for window, node in enumerate(heap[0][3]):
        where[node] = window
    for node in range(len(left) - 1, -1, -1):
        where[left[node]] = where[right[node]] = where[n + node]
    return np.array(where[:n], np.int64)


def near_equal(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Windows of at most ``capacity`` for all sizes, and how many there are.

    While a window is over the capacity, the number rises: by half of what the fullest window's distance from the mean
    asks for, by one at least.
    """
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        window = differencing(sizes, k)
        most = int(np.bincount(window, sizes, k).max(initial=0))
        if most <= capacity:
            return window, k
        room = max(1, capacity - (most - total // k))
        k += max(1, (-(-total // room) - k) // 2) if room > capacity // 2 else 1


def _pack(group: pa.Table, capacity: int) -> pa.Table:
    """A group's pieces with their windows; sequence ids are the group's number and the window's."""
    group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
    sizes = group["length"].to_numpy()
    full = int((sizes == capacity).sum())  # they come first
    window, k = near_equal(sizes[full:], capacity) if full < len(sizes) else (sizes[:0], 0)
    window = np.concatenate([k + np.arange(full), window]).astype(np.int64)
    order = np.lexsort((np.arange(len(window)), window))
    ends = np.cumsum(sizes[order])
    first = np.concatenate([[True], window[order][1:] != window[order][:-1]])
    offset = np.empty_like(ends)
    offset[order] = ends - sizes[order] - np.repeat((ends - sizes[order])[first], np.diff(np.append(np.flatnonzero(first), len(ends))))
    sequence = (group["__group"].to_numpy() << 32) + window
    return group.drop_columns("__group").append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece; with ``ids`` also the piece's ids,
    little-endian unsigned 32-bit numbers.

    ``path`` is the tokenizer file. A null or empty text is the one id ``END``. Repeated rows are packed each for itself, a
    null doc_id stays null; an empty table gives no pieces. Texts are whole, of any length. Sequence ids are unique, not
    dense; offsets in a sequence have no gaps. Windows take pieces from one group only.
    """
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(bpe.load(path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * ids
    cut = checkpoint(rows.mapInArrow(lambda it: _cut(it, spec, capacity, ids), schema))
    tokens, pieces = cut.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-tokens // GROUP_TOKENS), -(-pieces // GROUP_PIECES))
    dealt = cut.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(lambda t: _pack(t, capacity), schema + ", sequence_id long, offset long")


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, length, padding, pieces, ids): the windows put together; ``pieces`` must hold ids.

    ids is the concatenation in order of offset; padding is what is missing to the capacity, none where the length is a
    power of two.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    made = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    padding = F.when(F.bit_count("length") == 1, F.lit(0)).otherwise(F.lit(capacity) - F.col("length")).alias("padding")
    return made.select("sequence_id", "length", padding, F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["length"].alias("length"), p["offset"].alias("offset"))).alias("pieces"), joined.alias("ids"))
