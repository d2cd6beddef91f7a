"""Cross-entropy difference under two matched bigram models.

Target model: the documents that ``labels`` marks as good. Background model: all documents. Both share one vocabulary
and one smoothing, so a token's losses differ only by what the two corpora hold:

    p(w | u) = L * c(u, w) / c(u)  +  (1 - L) * (c(w) + 1) / (N + V)      or the last factor alone, if c(u) = 0

All counts run over whole texts of all documents, and every word and every bigram is listed: the counts lie spread over
buckets by hash, as many as the input needs, and none is gathered on the driver or broadcast. Each chunk of texts asks
every bucket once for the counts of its different keys (bigrams and words), so a hot key has one row a chunk; the
answers come back to the chunk, which scores its tokens. Keys are 55-bit hashes (among 10**12 keys, one in 36,000 shares
its hash with another); results hold up to their collisions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm._spark import BLOCK_BITS, NULL_ID, bit_index, checkpoint, filter_blocks, freeing_shuffles, join_sized, probe, ship
from gridweave.llm._text import LOWER, UPPER, WORD, chunks, mix, word_hashes

WEIGHT = 0.7
BUCKETS = 256
#: Bytes of text for each bucket of the whole model.
BUCKET_BYTES = 16_000_000
#: The lowest bit of a key tells bigrams from words; the hash of the start of a text, which no word has as its own.
BIGRAM, SINGLE = 0, 1
START_HASH = np.uint64(0x5851F42D4C957F2D)
#: The totals of chunk 0 have this bucket, those of others lower ones.
NONE = -1


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different keys of bigrams and words, sorted; where each token's bigram, word and context are; tokens a text."""
    words = [_words(t) for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    word = np.concatenate([word_hashes().of(w) for w in words]) if words else np.zeros(0, np.uint64)
    starts = (np.cumsum(counts) - counts)[counts > 0]
    context = np.concatenate([[START_HASH], word[:-1]]).astype(np.uint64)[: len(word)]
    context[starts] = START_HASH
    bigram = mix(mix(context) * np.uint64(0x9E3779B97F4A7C15) + word)
    keys, at = np.unique(np.concatenate([_key(bigram, BIGRAM), _key(mix(np.append(word, START_HASH)), SINGLE)]), return_inverse=True)
    single = at[len(word) : -1]
    before = np.concatenate([at[-1:], single[:-1]])[: len(word)]
    before[starts] = at[-1]
    return keys, at[: len(word)], single, before, counts


def _key(h: np.ndarray, kind: int) -> np.ndarray:
    return h >> np.uint64(9) << np.uint64(1) | np.uint64(kind)


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins and ends among sorted keys; buckets are ranges of the hash."""
    return np.searchsorted((keys >> np.uint64(24)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))


def _planes(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed planes of the bytes of their differences."""
    return zlib.compress(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unplaned(packed: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, n).T).view(np.uint64)[:, 0], dtype=np.uint64)


def _chunk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, ids, good, sizes, texts): many texts in one compressed binary."""
    first, i, codec = TaskContext.get().partitionId() << 32, 0, pa.Codec("zstd", compression_level=6)
    for part, texts in chunks(batches, limit=16_000_000):
        columns = [first + i], [part.column("doc_id").to_pylist()], [part.column("good").to_pylist()], [[len(t) for t in texts]], [codec.compress(b"".join(texts), asbytes=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CHUNK.types, strict=True)], schema=_CHUNK)
        i += 1


_CHUNK = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("good", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary())])


def _texts(sizes: list[int], packed: bytes) -> list[bytes]:
    whole = pa.decompress(packed, sum(sizes), "zstd", asbytes=True)
    return [whole[e - k : e] for e, k in zip(np.cumsum(sizes, dtype=np.int64).tolist(), sizes, strict=True)]


def _ask(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, chunk, n, keys, counts): the different keys of a chunk, sorted, as planes of bytes of differences.

    A key's four counts are of all and of the good texts, each as bigram or word and then as context.
    """
    for b in batches:
        for chunk, good, sizes, texts in zip(*(b.column(c).to_pylist() for c in ("chunk", "good", "sizes", "texts")), strict=True):
            keys, bigram, single, before, counts = _keys(_texts(sizes, texts))
            n = []
            for own in (slice(None), np.repeat(np.array(good, bool), counts)):
                n += [np.bincount(np.concatenate([bigram[own], single[own]]), minlength=len(keys)), np.bincount(before[own], minlength=len(keys))]
            n, edges = np.stack(n), _edges(keys, buckets)
            rows = [(k, z - a, _planes(keys[a:z]), _narrow(n[:, a:z])) for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False)) if z > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([chunk] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.binary()), (3, pa.binary())))], ["bucket", "chunk", "n", "keys", "counts"])


def _narrow(n: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs; their width follows from their number."""
    return zlib.compress(n.astype(np.min_scalar_type(int(n.max(initial=0)))).tobytes(), 1)


def _wide(packed: bytes, rows: int, n: int) -> np.ndarray:
    raw = zlib.decompress(packed)
    return np.frombuffer(raw, f"u{len(raw) // (rows * n)}").reshape(rows, n).astype(np.int64)


def _answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, bucket, counts): the corpus counts of what a chunk asked for, in its order.

    Rows are sorted by bucket; one bucket is held at a time.
    """
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    now = None

    def done() -> pa.RecordBatch:
        keys, back = np.unique(np.concatenate([k for _, k, _ in held]), return_inverse=True)
        total, at, rows = np.zeros((4, len(keys)), np.int64), 0, []
        for _, k, n in held:  # the keys of one row are all different
            total[:, back[at : at + len(k)]] += n
            at += len(k)
        at = 0
        for chunk, k, _ in held:
            rows.append((chunk, now, _narrow(total[:, back[at : at + len(k)]])))
            at += len(k)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["chunk", "bucket", "counts"])

    for b in batches:
        for bucket, chunk, n, keys, counts in zip(*(b.column(c).to_pylist() for c in ("bucket", "chunk", "n", "keys", "counts")), strict=True):
            if bucket != now and held:
                yield done()
                held = []
            now = bucket
            held.append((chunk, _unplaned(keys, n), _wide(counts, 4, n)))
    if held:
        yield done()


_WORDS = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("all", pa.int64()), ("good", pa.int64())])


def _list_words(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, n, keys) of each chunk's different words, and a row with its tokens on either side."""
    for b in batches:
        for chunk, good, sizes, texts in zip(*(b.column(c).to_pylist() for c in ("chunk", "good", "sizes", "texts")), strict=True):
            words = [_words(t) for t in _texts(sizes, texts)]
            keys = np.unique(_key(mix(word_hashes().of(list({w for ws in words for w in ws}))), SINGLE))
            edges = _edges(keys, buckets)
            rows = [(k, z - a, _planes(keys[a:z]), 0, 0) for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False)) if z > a]
            rows.append((NONE - chunk, 0, b"", sum(map(len, words)), sum(len(w) for w, g in zip(words, good, strict=True) if g)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _WORDS.types, strict=True)], schema=_WORDS)


def _count_listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (words, all, good) for each bucket; rows are sorted by bucket, and one bucket's different words are held."""
    held, now = np.zeros(0, np.uint64), NONE
    for b in batches:
        out = []
        for bucket, n, keys, whole, good in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if bucket != now:
                out.append((len(held), 0, 0))
                held, now = held[:0], bucket
            if bucket <= NONE:
                out.append((0, whole, good))
            else:
                held = np.union1d(held, _unplaned(keys, n))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["words", "all", "good"])
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (len(held), 0, 0)], ["words", "all", "good"])


def _sides(batches: Iterable[pa.RecordBatch], buckets: int, totals: tuple[int, int, int], weight: float) -> Iterator[pa.RecordBatch]:
    """Scores of each chunk's texts from the chunk's row (bucket -1) and the answers after it, sorted by bucket."""
    size, *sums = totals
    held, answers = None, {}

    def done() -> pa.RecordBatch:
        ids, texts = held
        keys, bigram, single, before, counts = _keys(texts)
        known, edges, losses = np.zeros((4, len(keys)), np.int64), _edges(keys, buckets), []
        for k in np.flatnonzero(np.diff(edges)):
            known[:, edges[k] : edges[k + 1]] = _wide(answers[int(k)], 4, edges[k + 1] - edges[k])
        for (n, contexts), total in ((known[2:], sums[1]), (known[:2], sums[0])):  # target, background
            alone, seen = (n[single] + 1) / (total + size), contexts[before]
            share = np.divide(weight * n[bigram], seen, out=np.zeros(len(seen)), where=seen > 0)
            loss = -np.log(share + np.where(seen > 0, 1 - weight, 1) * alone)
            mean = np.zeros(len(counts))
            if len(loss):
                mean[counts > 0] = np.add.reduceat(loss, (np.cumsum(counts) - counts)[counts > 0])
            losses.append(mean / np.maximum(counts, 1))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts), *map(pa.array, losses), pa.array(losses[0] - losses[1])], ["doc_id", "n_tokens", "target_loss", "background_loss", "loss_difference"])

    for b in batches:
        for bucket, ids, sizes, texts, counts in zip(*(b.column(c).to_pylist() for c in ("bucket", "ids", "sizes", "texts", "counts")), strict=True):
            if bucket < 0:
                if held:
                    yield done()
                held, answers = (ids, _texts(sizes, texts)), {}
            else:
                answers[bucket] = counts
    if held:
        yield done()


def _marks(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A bit filter of fixed size that finds the rows (rid) of ``docs`` marked as good where they are, and ids that it takes wrongly."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("rid")).distinct()
    blocks = filter_blocks(good, F.xxhash64("rid"))
    maybe = probe(docs.select("rid", F.xxhash64("rid").alias("h")), F.col("h"), blocks).select("rid").distinct()
    return blocks, checkpoint(maybe.join(good, "rid", "left_anti"))


def _flagged(docs: DataFrame, blocks: DataFrame, wrong: DataFrame) -> DataFrame:
    """``docs`` with ``good``; no row is dropped or moved but for what the filter takes wrongly."""
    at = bit_index(F.xxhash64("rid"), 26)
    hit = docs.withColumns({"block": (at / BLOCK_BITS).cast("long"), "at": (at % BLOCK_BITS).cast("int")}).join(F.broadcast(blocks), "block", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = hit.withColumn("hit", F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, at % 8)")) != 0, F.lit(False))).drop("block", "at", "bits")
    return join_sized(hit, wrong.withColumn("wrong", F.lit(True)), "rid", "left").withColumn("good", F.col("hit") & F.col("wrong").isNull())


def score(docs: DataFrame, labels: DataFrame, weight: float = WEIGHT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (mean nats a token) and loss_difference; lower: closer to the target.

    Tokens are what ASCII white space separates, A-Z in lower case. Texts without tokens have zero tokens and losses of
    0. Repeated rows are counted and scored each; a repeated id is in the target if any of its labels says so. Labels of
    null, or of a null id, mark nothing. With an empty target both sides back off to equal words. An empty table gives
    an empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("rid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks, wrong = _marks(rows, labels)
    # the ids of chunks hold for one run of the tasks that cut them, so what they cut is kept
    cut = checkpoint(_flagged(rows, blocks, wrong).select("doc_id", "good", "text").mapInArrow(_chunk, "chunk long, ids array<long>, good array<boolean>, sizes array<long>, texts binary"))
    buckets = max(BUCKETS, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes)
    listed = cut.select("chunk", "good", "sizes", "texts").mapInArrow(lambda it: _list_words(it, buckets), "bucket long, n long, keys binary, all long, good long")
    listed = listed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count_listed, "words long, all long, good long")
    with freeing_shuffles(docs.sparkSession):
        words, *sums = (x or 0 for x in listed.agg(F.sum("words"), F.sum("all"), F.sum("good")).first())
    totals = (words + 1, *sums)  # one unknown word
    asked = cut.mapInArrow(lambda it: _ask(it, buckets), "bucket long, chunk long, n long, keys binary, counts binary")
    # kept, so that the questions' shuffle is gone before the answers' begins
    answers = checkpoint(asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answer, "chunk long, bucket long, counts binary"))
    both = cut.drop("good").withColumn("bucket", F.lit(-1).cast("long")).unionByName(answers, allowMissingColumns=True)
    met = both.repartition("chunk").sortWithinPartitions("chunk", "bucket").select("bucket", "ids", "sizes", "texts", "counts")
    return met.mapInArrow(lambda it: _sides(it, buckets, totals, weight), "doc_id long, n_tokens long, target_loss double, background_loss double, loss_difference double")


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
toks AS (SELECT r, doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM docs),
pairs AS (SELECT r, w, lag(w, 1, ' start') OVER (PARTITION BY r ORDER BY p) AS u,
  coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good FROM toks),
two AS (SELECT u, w, count(*) AS b, count(*) FILTER (good) AS t FROM pairs GROUP BY u, w),
ctx AS (SELECT u, sum(b) AS b, sum(t) AS t FROM two GROUP BY u),
wrd AS (SELECT w, sum(b) AS b, sum(t) AS t FROM two GROUP BY w),
tot AS (SELECT coalesce(sum(b), 0) AS b, coalesce(sum(t), 0) AS t, count(*) + 1 AS v FROM wrd),
loss AS (SELECT r,
  -ln(CASE WHEN ctx.t > 0 THEN {WEIGHT} * two.t::DOUBLE / ctx.t ELSE 0 END + CASE WHEN ctx.t > 0 THEN 1 - {WEIGHT} ELSE 1 END * (wrd.t + 1)::DOUBLE / (tot.t + tot.v)) AS t,
  -ln({WEIGHT} * two.b::DOUBLE / ctx.b + (1 - {WEIGHT}) * (wrd.b + 1)::DOUBLE / (tot.b + tot.v)) AS b
  FROM pairs JOIN two USING (u, w) JOIN ctx USING (u) JOIN wrd USING (w), tot)
SELECT any_value(doc_id) AS doc_id, count(loss.r) AS n_tokens, round(coalesce(avg(t), 0), 6) AS target_loss, round(coalesce(avg(b), 0), 6) AS background_loss,
  round(coalesce(avg(t) - avg(b), 0), 6) AS loss_difference
FROM docs LEFT JOIN loss USING (r) GROUP BY r
"""
