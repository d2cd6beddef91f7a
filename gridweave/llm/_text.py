"""Small numpy helpers over words and their hashes; they run inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: ASCII white space of the contracts: what ``bytes.split()`` splits at.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PUNCTUATION_TO_SPACE = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


class WordHashes(dict):
    """XXH64 of words, kept for the words seen lately."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_HASHES = WordHashes()
#: Frees what other operators keep in a Python worker between tasks.
LET_GO: list[Callable[[], None]] = []


def word_hashes() -> WordHashes:
    """The Python worker's cache, which lives on between tasks; those of other operators go."""
    for free in LET_GO:
        free()
    return _HASHES


def raw(column: pa.Array) -> list[bytes]:
    """A string column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def plain_words(text: bytes) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.decode().lower().encode().translate(PUNCTUATION_TO_SPACE).split()


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with at most ``limit`` bytes of text or one row, and their texts."""
    for batch in batches:
        texts = raw(batch.column(column))
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive values, from hashes of 1, 2, 4, ... values."""
    out, length, block, size = None, 0, h, 1

    def join(a: np.ndarray, b: np.ndarray, skip: int) -> np.ndarray:
        m = max(0, len(b) - skip)
        return mix(mix(a[:m]) * np.uint64(0x9E3779B97F4A7C15) + b[skip:])

    while True:
        if n & size:
            out, length = (block if size > 1 else mix(block), size) if out is None else (join(out, block, length), length + size)
        if size * 2 > n:
            return out
        block, size = join(block, block, size), size * 2


def sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    """The smallest of every ``n`` consecutive values."""
    size = 1
    while size * 2 <= n:
        h, size = np.minimum(h[:-size], h[size:]) if len(h) > size else h[:0], size * 2
    rest = n - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest and len(h) > rest else h[: max(0, len(h) - rest)]


def binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of ``values`` as one binary each."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column one after another, and how many each row has."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data.view(dtype) if data.flags.aligned and not data.ctypes.data % np.dtype(dtype).itemsize else data.copy().view(dtype), np.diff(ends) // np.dtype(dtype).itemsize

