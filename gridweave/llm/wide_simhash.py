"""SimHash near-duplicates by similarity: wide fingerprints, pigeonhole blocks, exact verification, an exact way for the rest.

Texts whose sets of five-word shingles have a similarity (Jaccard) of 0.8 differ in 15 % of the bits of their
fingerprints. In 64 bits no block long enough to be selective survives that, so a fingerprint here has 2,048 bits, read
in blocks of 20 bits that begin at every 16th, and two texts meet wherever a block agrees: from independent bits, pairs of
similarity 0.8 do with probability 0.99. Blocks get longer with the number of texts, so that a block's value is shared by
few by chance; those over 24 bits (from 67 million texts on) begin at every 8th or 4th bit instead (``shape``).

Pairs that meet are candidates if the distance of all 2,048 bits, which tells the similarity to about 0.02 (one standard
deviation), leaves a similarity of ``LOOSE`` possible. Candidates are then judged by their shingle sets themselves, so the
estimate links nobody.

Equal shingle sets are folded first. Blocks travel with 64 bits only, and those who meet nobody of about their own 64
bits go no further; the rest bring their whole fingerprints. A block value that more than ``limit`` fingerprints share
is judged in pairs of pieces, each in a task of its own, so memory is bounded and no pair is left out.

What fingerprints miss by chance is found without chance (``missed``): in any one order of all shingles, two sets of the
similarity share one of their first ``opening`` shingles. Texts that do so and are not connected yet are candidates if
their sizes, the places of the shared shingle and the parities of 2,048 classes of shingles allow it; these bounds hold
for every pair of the similarity. Shingles that a sample of texts shows to be common come last in the order, which spares
candidates and changes no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm._spark import BROADCAST_ROWS, NULL_ID, checkpoint, complete_runs, connected_components, join_sized, row_key, ship
from gridweave.llm._text import binary, chunks, mix, rolling, unpacked, word_hashes
from gridweave.llm.simhash import _first, _of_components

SHINGLE, SIMILARITY = 5, 0.8
#: The similarity, as fingerprints tell it, from which a pair is judged by its shingles; further ones for large groups.
LOOSE, SURER = 0.72, (0.8, 0.87)
#: Up to so many that meet under a block, all near pairs are candidates; of more, those that connect them.
FEW = 32
#: 64-bit words of a fingerprint.
WORDS = 32
#: A text in so many tells which shingles are common: those of so many texts of the sample, at most so many of them.
SAMPLED, SHARED, COMMON = 16, 4, 1_000_000
#: Different bits, of the 64 that travel with a block, beyond which two fingerprints are not compared: similar ones
#: differ in 10 of them with a deviation of 3.
NEAR = 22
_LANES = np.uint64(0x0101010101010101)
_SEEDS = mix(np.arange(1, WORDS + 1, dtype=np.uint64))


def shingles(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Different hashes of the ``n``-word shingles of the lower-cased text; of all its words where there are fewer."""
    words = text.lower().split()
    if len(words) >= n:
        return np.unique(rolling(word_hashes().of(words), n))
    return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """2,048 bits: a bit is 1 if it is set in over half of the hashes, each widened by mixing; zero without hashes."""
    counts = np.zeros((8, WORDS * 8), np.int64)
    for i in range(0, len(hashes), 255):  # eight byte counters in a word hold up to 255
        rows = mix(hashes[i : i + 255, None] ^ _SEEDS)
        for bit in range(8):
            counts[bit] += ((rows >> np.uint64(bit)) & _LANES).sum(axis=0).view(np.uint8)
    return np.packbits((counts.T * 2 > len(hashes)).reshape(-1), bitorder="little").view(np.uint64)


def opening(size: int, similarity: float) -> int:
    """In any one order, two sets of the similarity share one of their first so many elements."""
    return size - math.ceil(similarity * size - 1e-9) + 1


def differing(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Elements in one only of two sets of sizes a and b, up to which they have the similarity."""
    return np.floor((a + b) * (1 - similarity) / (1 + similarity) + 1e-6)


def parity(hashes: np.ndarray) -> np.ndarray:
    """Whether the hashes of each of 2,048 classes are odd in number: sets differ in as many bits as elements at most."""
    return np.packbits((np.bincount((hashes & np.uint64(WORDS * 64 - 1)).astype(np.int64), minlength=WORDS * 64) & 1).astype(np.uint8)).view(np.uint64)


def _opening(s: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
    return np.concatenate([s[~last], s[last]])[: opening(len(s), similarity)]


def _fingerprints(batches: Iterable[pa.RecordBatch], n: int, common, similarity: float) -> Iterator[pa.RecordBatch]:
    for b, texts in chunks(batches):
        sets = [shingles(t, n) for t in texts]
        wide = np.concatenate([wide_fingerprint(s) for s in sets])
        sizes = np.array([len(s) for s in sets], np.int64)
        rows = wide.reshape(-1, WORDS)
        node = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
        odd = np.concatenate([parity(s) for s in sets])
        first = [_opening(s, common.value, similarity) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("th"), pa.array(node), pa.array(sizes), *(binary(x, np.full(len(rows), WORDS)) for x in (wide, odd)), binary(np.concatenate(first), np.array([len(x) for x in first], np.int64))],
            ["doc_id", "th", "node", "size", "wide", "odd", "first_ones"],
        )


def shape(n: int) -> tuple[int, int]:
    """A block's width in bits, for which some four of ``n`` fingerprints share a value by chance at most, and the bits
    from one block's beginning to the next one's."""
    width = min(32, max(20, n.bit_length() - 2))
    return width, 16 if width <= 24 else 8 if width <= 28 else 4


def _blocks(batches: Iterable[pa.RecordBatch], width: int, step: int) -> Iterator[pa.RecordBatch]:
    """(key, node, bits): every block of every fingerprint, with its number in the key, and 64 bits from elsewhere in it."""
    at = np.arange(0, WORDS * 64, step)
    word, off = at // 64, (at % 64).astype(np.uint64)
    for whole in batches:
        for i in range(0, whole.num_rows, 512):
            b = whole.slice(i, 512)
            rows = unpacked(b.column("wide"), np.uint64)[0].reshape(-1, WORDS)
            low = rows[:, word] >> off
            high = np.where(off > 0, rows[:, (word + 1) % WORDS] << (np.uint64(63) - off) << np.uint64(1), np.uint64(0))
            key = ((low | high) & np.uint64(2**width - 1)) | (np.arange(len(at), dtype=np.uint64) << np.uint64(32))
            bits = rows[:, (word + WORDS // 2) % WORDS].view(np.int64)
            node = np.repeat(b.column("node").to_numpy(), len(at))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(node), pa.array(np.ascontiguousarray(bits).reshape(-1))], ["key", "node", "bits"])


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys start, and their lengths."""
    other = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        other |= k[1:] != k[:-1]
    starts = np.concatenate([[0], np.flatnonzero(other) + 1])
    return starts, np.diff(np.append(starts, len(keys[0])))


def _company(batches: Iterable[pa.RecordBatch], crowd: int = 256) -> Iterator[pa.RecordBatch]:
    """The (key, node) that meet somebody near under their key; of runs over ``crowd``, everybody."""
    cut = None  # the key of the run that came in pieces
    for t in complete_runs(batches, ["key"], 65_536, pieces=True):
        key, node, bits = t["key"].to_numpy(), t["node"].to_numpy(), t["bits"].to_numpy().view(np.uint64)
        starts, sizes = _runs(key)
        keep = np.repeat(sizes > crowd, sizes)
        rest = cut == key[0]
        if rest:
            keep[: sizes[0]] = True
        cut = key[-1] if len(sizes) == 1 and (rest or sizes[0] > crowd) else None
        ends = np.repeat(starts + sizes, sizes)
        at = np.flatnonzero(~keep)
        for apart in range(1, crowd):
            at = at[at + apart < ends[at]]
            if not len(at):
                break
            near = at[np.bitwise_count(bits[at] ^ bits[at + apart]) <= NEAR]
            keep[near] = keep[near + apart] = True
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep])], ["key", "node"])


def allowed(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Different bits up to which sets of sizes a and b count as similar; -1 where their sizes rule it out."""
    cos = similarity / (1 + similarity) * (a + b) / np.sqrt(np.maximum(a * b, 1))
    return np.where((cos <= 1) & (a * b > 0), np.arccos(np.minimum(cos, 1)) / np.pi * WORDS * 64, -1)


def _spanning(wide: np.ndarray, sizes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places of linked pairs that connect what similarity connects, one per fingerprint at most."""
    out, left = [], np.arange(len(sizes))
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            head = front.pop()
            apart = np.bitwise_count(wide[left] ^ wide[head]).sum(axis=1)
            near = apart <= allowed(sizes[left], sizes[head], similarity)
            out += [(head, x) for x in left[near]]
            front += list(left[near])
            left = left[~near]
    return out


def _candidates(wide: np.ndarray, sizes: np.ndarray, loose: float) -> list[tuple[int, int]]:
    """Places of pairs to judge: all near ones of few fingerprints; of many, those that connect them at several degrees of
    nearness, so that one that turns out not to be similar is not all that a text has."""
    if len(sizes) > FEW:
        return [p for s in (loose, *SURER) for p in _spanning(wide, sizes, s)]
    i, j = np.triu_indices(len(sizes), 1)
    near = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1) <= allowed(sizes[i], sizes[j], loose)
    return list(zip(i[near].tolist(), j[near].tolist(), strict=True))


def _link(batches: Iterable[pa.RecordBatch], loose: float) -> Iterator[pa.RecordBatch]:
    for t in complete_runs(batches, ["key", "p", "q"], 8_192):
        node, sizes = t["node"].to_numpy(), t["size"].to_numpy().astype(float)
        wide = unpacked(t["wide"], np.uint64)[0].reshape(-1, WORDS)
        starts, lengths = _runs(*(t[c].to_numpy() for c in ("key", "p", "q")))
        two = starts[lengths == 2]
        two = two[np.bitwise_count(wide[two] ^ wide[two + 1]).sum(axis=1) <= allowed(sizes[two], sizes[two + 1], loose)]
        pairs = [np.stack([two, two + 1], axis=1)]
        for s, n in zip(starts[lengths > 2], lengths[lengths > 2], strict=True):
            if found := _candidates(wide[s : s + n], sizes[s : s + n], loose):
                pairs.append(np.array(found) + s)
        met = node[np.concatenate(pairs)]
        a, b = np.unique(np.sort(met, axis=1), axis=0).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], ["a", "b"])


def _in_pieces(met: DataFrame, limit: int) -> DataFrame:
    """``met`` (key, node, ...) with p and q: rows of a key that has over ``limit`` come once for each pair of its pieces."""
    crowded = checkpoint(met.groupBy("key").count().filter(F.col("count") > limit).select("key", F.ceil(F.col("count") / limit * 2).alias("pieces")))
    cut = join_sized(met, crowded, ["key"], "left", BROADCAST_ROWS).withColumn("piece", F.pmod(F.xxhash64("node"), F.coalesce("pieces", F.lit(1))))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("pieces", F.lit(1)) - 1)).alias("other")
    return cut.select(*met.columns, "piece", other).select(*met.columns, F.least("piece", "other").alias("p"), F.greatest("piece", "other").alias("q"))


def candidates(folded: DataFrame, loose: float = LOOSE, limit: int = 16_384) -> DataFrame:
    """Pairs (a, b) of different nodes of ``folded`` (node, size, wide) whose fingerprints meet and are near."""
    width, step = shape(folded.count())
    sent = folded.select("node", "wide").mapInArrow(lambda it: _blocks(it, width, step), "key long, node long, bits long")
    met = checkpoint(sent.repartition("key").sortWithinPartitions("key").mapInArrow(_company, "key long, node long"))
    whole = _in_pieces(met, limit).join(folded.select("node", "size", "wide"), "node")
    found = whole.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(lambda it: _link(it, loose), "a long, b long")
    return checkpoint(found.distinct())


def _sets(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b, texts in chunks(batches):
        sets = [shingles(t, n) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column("node"), binary(np.concatenate(sets), np.array([len(s) for s in sets], np.int64))], ["node", "shingles"])


def _similar(batches: Iterable[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, docs: DataFrame, folded: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity; ``folded`` tells a row of each node by ``first``.

    Only texts that have a candidate are read again. Hashes of shingles stand for them.
    """
    nodes = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    first = folded.join(nodes, "node").select("node", F.coalesce("first.doc_id", F.lit(NULL_ID)).alias("__rid"), F.col("first.th").alias("__th"))
    rid, th = row_key()
    texts = docs.select(rid.alias("__rid"), th.alias("__th"), F.col("text").cast("string").alias("text"))
    rows = join_sized(texts, checkpoint(first), ["__rid", "__th"], "inner", BROADCAST_ROWS).select("node", "text")
    sets = checkpoint(rows.mapInArrow(lambda it: _sets(it, shingle), "node long, shingles binary").dropDuplicates(["node"]))
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return checkpoint(both.mapInArrow(lambda it: _similar(it, similarity), "a long, b long"))


def _shingles(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for _, texts in chunks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t, n) for t in texts]).view(np.int64))], ["shingle"])


def common_shingles(texts: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of shingles that many texts have, ``COMMON`` at most, by every ``SAMPLED``-th text; they only order."""
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text")
    counts = some.mapInArrow(lambda it: _shingles(it, n), "shingle long").groupBy("shingle").count().filter(F.col("count") >= SHARED)
    found = counts.orderBy(F.desc("count"), "shingle").limit(COMMON).select("shingle").toArrow()["shingle"].to_numpy()
    return np.sort(found.astype(np.int64, copy=True).view(np.uint64))


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, size, place) of each first shingle."""
    for whole in batches:
        for i in range(0, whole.num_rows, 512):
            b = whole.slice(i, 512)
            keys, n = unpacked(b.column("first_ones"), np.int64)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n)
            each = (np.repeat(b.column(c).to_numpy(), n) for c in ("node", "size"))
            yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, each), pa.array(place)], ["key", "node", "size", "place"])


def _several(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key has another; a batch's last key is told by the row after it."""
    held = None  # the row before, which has not been told yet, and whether its key is known to have another
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if held is None else [held[0], b]).combine_chunks()
        key = t["key"].to_numpy()
        same = key[1:] == key[:-1]
        keep = np.concatenate([[held is not None and held[1]], same]) | np.concatenate([same, [False]])
        held = t.slice(len(key) - 1).to_batches()[0], bool(keep[-1])
        yield from t.slice(0, len(key) - 1).filter(pa.array(keep[:-1])).to_batches()
    if held and held[1]:
        yield held[0]


def _possible(batches: Iterable[pa.RecordBatch], similarity: float, many: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of a run, from different components, whose sizes and places of the key allow the similarity."""
    made, n = [], 0

    def pairs() -> pa.RecordBatch:
        a, b = np.unique(np.sort(np.concatenate(made), axis=1), axis=0).T if made else np.zeros((2, 0), np.int64)
        made.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], ["a", "b"])

    for t in complete_runs(batches, ["key", "p", "q"], 8_192):
        key, p, q, node, size, place, of = (t[c].to_numpy() for c in ("key", "p", "q", "node", "size", "place", "component"))
        left = size - place  # with the key's own shingle
        starts, lengths = _runs(key, p, q)
        for s, e in zip(starts, starts + lengths, strict=True):
            if (of[s:e] == of[s]).all():
                continue
            for i in range(s, e - 1):
                rest = slice(i + 1, e)
                common = size[i] + size[rest] - differing(size[i], size[rest], similarity)  # twice what they must share
                ok = (of[rest] != of[i]) & (2 * np.minimum(left[i], left[rest]) >= common)
                if found := int(ok.sum()):
                    made.append(np.stack([np.full(found, node[i]), node[rest][ok]], axis=1))
                    n += found
                if n >= many:
                    yield pairs()
                    n = 0
    yield pairs()


def _near_parities(batches: Iterable[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (unpacked(b.column(c), np.uint64)[0].reshape(-1, WORDS) for c in ("x", "y"))
        sizes = (b.column(c).to_numpy() for c in ("m", "n"))
        yield b.select(["a", "b"]).filter(pa.array(np.bitwise_count(x ^ y).sum(axis=1) <= differing(*sizes, similarity)))


def missed(folded: DataFrame, near: DataFrame, similarity: float, limit: int) -> DataFrame:
    """Pairs (a, b) that may have the similarity and are not connected by ``near``: all that have it are among them.

    ``folded`` has (node, size, odd, first_ones).
    """
    large = folded.filter(F.col("size") >= similarity / (1 - similarity) - 1e-6)  # smaller sets are similar to equal ones only
    rows = large.select("node", "size", "first_ones").mapInArrow(_opened, "key long, node long, size long, place long")
    met = checkpoint(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_several, "key long, node long, size long, place long"))
    of = met.join(connected_components(near), "node", "left").withColumn("component", F.coalesce("component", "node"))
    dealt = _in_pieces(checkpoint(of), limit).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    pairs = checkpoint(dealt.mapInArrow(lambda it: _possible(it, similarity), "a long, b long").distinct())
    left = pairs.join(folded.select(F.col("node").alias("a"), F.col("odd").alias("x"), F.col("size").alias("m")), "a")
    both = left.join(folded.select(F.col("node").alias("b"), F.col("odd").alias("y"), F.col("size").alias("n")), "b")
    return checkpoint(both.mapInArrow(lambda it: _near_parities(it, similarity), "a long, b long"))


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, limit: int = 16_384) -> DataFrame:
    """doc_id, th, node, component_id, stays for every row of ``docs`` (doc_id, text).

    Texts are linked if their shingle sets have the similarity; components are what links connect. Texts equal but for case and white space are always linked; so are all texts without words. Shorter
    texts than a shingle are linked to equal ones only. Of a component the rows with the smallest doc_id, and of these
    with the smallest th, stay; null ids come last. Repeated rows give repeated rows; an empty table gives none.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key()[1], F.col("text").cast("string").alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(rows, shingle))
    kept = "doc_id long, th long, node long, size long, wide binary, odd binary, first_ones binary"
    each = checkpoint(rows.mapInArrow(lambda it: _fingerprints(it, shingle, common, similarity), kept))
    common.unpersist()
    folded = checkpoint(each.groupBy("node").agg(_first(), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("size", "wide", "odd", "first_ones"))))
    near = verified(candidates(folded, min(LOOSE, similarity), limit), docs, folded, shingle, similarity)
    rest = verified(missed(folded, near, similarity, limit), docs, folded, shingle, similarity)
    return _of_components(each.select("doc_id", "th", "node"), folded, near.union(rest), "node")
