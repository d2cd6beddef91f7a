"""A Merkle manifest of a dataset, and inclusion proofs by octopus multiproof.

Rows are leaves of one tree a language; the languages' roots are the leaves of the tree above. Every eight consecutive nodes
(the last run may have fewer) become one. Trees are built where the leaves lie: each task folds the runs that are whole
within the consecutive leaves it sees, and gives on only the nodes whose runs others share; these are folded level by level,
an eighth of the nodes a level.

Proofs are made a leaf partition (``PART`` consecutive leaves of a tree) at a time. A partition works out which nodes its
leaves' proofs need and its own leaves cannot give: at each level the siblings, outside its interval, of the runs that the
interval touches. Requests of all partitions meet the nodes in one join (nodes near the root, which all ask for, are few and
broadcast by count), the partition gets its nodes before its leaves in one sorted pass, derives the interiors that proofs
share once, and spells out each leaf's proof from what it then has.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm._spark import BROADCAST_ROWS, checkpoint, join_sized, join_skewed, ship
from gridweave.llm._text import LOWER, UPPER
from gridweave.shared import numbered

FANIN = 8
#: Leaves of a partition, the unit that fetches together; a power of FANIN.
PART = 4096
#: Leaves that a task folds at once while it builds.
HELD = 32_768
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(**replaced: Column) -> Column:
    """SHA-256 of the row's columns, each ``-`` if null, else its bytes' count, a colon and the value."""
    parts = []
    for name in COLUMNS:
        value = replaced.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _joined(digests: Iterable[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def sizes(n: int) -> list[int]:
    """How many nodes each level of a tree of ``n`` leaves has, the root last."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FANIN))
    return out


def missing(n: int, first: int, last: int) -> list[tuple[int, int]]:
    """(level, index) of the nodes that proofs of the leaves first..last need and these leaves do not give, in order."""
    out = []
    for level, nodes in enumerate(sizes(n)[:-1]):
        low, high = first // FANIN * FANIN, min((last // FANIN + 1) * FANIN, nodes)
        out += [(level, i) for i in (*range(low, first), *range(last + 1, high))]
        first, last = first // FANIN, last // FANIN
    return out


def _fold(n: int, first: int, digests: list[str], stored: int) -> Iterator[tuple[int, int, str, bool]]:
    """(level, index, digest, open) from consecutive leaves: open nodes, whose runs reach beyond them, and all nodes from
    level ``stored`` on; the root is not open."""
    own = dict(enumerate(digests, first))
    for level, nodes in enumerate(sizes(n)):
        above: dict[int, str] = {}
        for run in dict.fromkeys(i // FANIN for i in own):
            at = range(run * FANIN, min((run + 1) * FANIN, nodes))
            whole = at[0] in own and at[-1] in own  # consecutive: the ends tell
            if nodes > 1 and whole:
                above[run] = _joined(own[i] for i in at)
            if nodes == 1 or not whole or level >= stored:
                yield from ((level, i, own[i], nodes > 1 and not whole) for i in at if i in own)
        own = above


def _frontier(batches: Iterable[pa.RecordBatch], stored: int) -> Iterator[pa.RecordBatch]:
    tree, n, first, held = None, 0, 0, []

    def nodes() -> Iterator[pa.RecordBatch]:
        if found := list(_fold(n, first, held, stored)) if held else []:
            columns = [[tree] * len(found), [n] * len(found), *zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()), strict=True)], ["tree", "n", "level", "idx", "digest", "open"])

    for batch in batches:
        for t, size, pos, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if t != tree or pos != first + len(held) or pos % HELD == 0:
                yield from nodes()
                tree, n, first, held = t, size, pos, []
            held.append(digest)
    yield from nodes()


def _requests(batches: Iterable[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(t, pos // part, level, i) for t, n, pos in zip(*(c.to_pylist() for c in batch.columns), strict=True) for level, i in missing(n, pos, min(pos + part, n) - 1)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["tree", "part", "level", "idx"])


def _expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proofs of each partition's leaves; rows come by (tree, part), fetched nodes before leaves, leaves in order.

    Columns behind the first six belong to the leaves and are passed on.
    """
    key, n, have, leaves, kept, names, types = None, 0, {}, [], [], [], []

    def proofs() -> Iterator[pa.RecordBatch]:
        if not leaves:
            return
        counts = sizes(n)
        first, last = leaves[0], leaves[-1]
        for level, nodes in enumerate(counts[:-2]):  # interiors that the leaves give, each once
            for run in range(first // FANIN, last // FANIN + 1):
                have[level + 1, run] = _joined(have[level, i] for i in range(run * FANIN, min((run + 1) * FANIN, nodes)))
            first, last = first // FANIN, last // FANIN
        left, right = [], []
        for pos in leaves:
            before, after = [], []
            for level, nodes in enumerate(counts[:-1]):
                start = pos // FANIN * FANIN
                before.append("".join([have[level, i] for i in range(start, pos)]))
                after.append("".join([have[level, i] for i in range(pos + 1, min(start + FANIN, nodes))]))
                pos //= FANIN
            left.append(before)
            right.append(after)
        columns = [pa.array([key[0]] * len(leaves), pa.string()), pa.array(leaves, pa.int64()), pa.array([have[0, i] for i in leaves], pa.string()), *(pa.array(c, t) for c, t in zip(zip(*kept, strict=True), types, strict=True)), *(pa.array(x, pa.list_(pa.string())) for x in (left, right))]
        yield pa.RecordBatch.from_arrays(columns, ["tree", "pos", "digest", *names, "left", "right"])

    for batch in batches:
        names, types = batch.schema.names[6:], batch.schema.types[6:]
        for tree, part, level, idx, digest, size, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (tree, part):
                yield from proofs()
                key, have, leaves, kept = (tree, part), {}, [], []
            if level < 0:  # a leaf of the partition
                leaves.append(idx)
                kept.append(more)
                n, level = size, 0
            have[level, idx] = digest
    yield from proofs()


@dataclass
class Forest:
    """Trees over ordered leaves: ``leaves`` (tree, pos, digest, n, ...), ``nodes`` (tree, level, idx, digest) from the level
    of a partition's root on, ``roots`` (tree, n, digest), ``part`` the leaves of a partition, a power of ``FANIN``."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    part: int

    def proofs(self) -> DataFrame:
        """(tree, pos, digest, ..., left, right): at each level from the leaf up, the joined digests of the siblings before
        and after; further columns of the leaves are kept."""
        part, more = self.part, [f for f in self.leaves.schema if f.name not in ("tree", "pos", "digest", "n")]
        plain = self.leaves.select("tree", F.expr(f"pos div {part}").alias("part"), F.lit(-1).alias("level"), F.col("pos").alias("idx"), "digest", "n", *(f.name for f in more))
        asked = checkpoint(self.leaves.filter(F.col("pos") % part == 0).select("tree", "n", "pos").mapInArrow(lambda it: _requests(it, part), "tree string, part long, level int, idx long"))
        counts = asked.groupBy("tree", "level", "idx").agg(F.count("*").alias("n"))
        known = checkpoint(counts.join(self.nodes, ["tree", "level", "idx"]).select(F.struct("tree", "level", "idx").alias("node"), "digest", "n"))
        met = join_skewed(asked.select(F.struct("tree", "level", "idx").alias("node"), "part"), known, "node", asked.count())
        fetched = met.select("node.tree", "part", "node.level", "node.idx", "digest", F.lit(0).cast("long").alias("n"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in more))
        sent = plain.unionByName(fetched).withColumn("__leaf", F.col("level") < 0)
        placed = sent.repartition("tree", "part").sortWithinPartitions("tree", "part", "__leaf", "idx").drop("__leaf")
        kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in more)
        return placed.mapInArrow(_expand, f"tree string, pos long, digest string{kept}, left array<string>, right array<string>")


def forest(leaves: DataFrame, part: int = PART) -> Forest:
    """``leaves``: (tree, pos, digest, n, ...), pos from 0 to n - 1 in each tree, cheap to read more than once; best in that
    order within its partitions, as ``placed`` gives them, since runs that a task sees whole are not shuffled."""
    ship(leaves.sparkSession)
    stored = len(sizes(part)) - 1
    if FANIN**stored != part:
        raise ValueError(f"a partition's leaves are a power of {FANIN}, not {part}")
    made = checkpoint(leaves.select("tree", "n", "pos", "digest").mapInArrow(lambda it: _frontier(it, stored), "tree string, n long, level int, idx long, digest string, open boolean"))
    most = made.agg(F.max("n")).first()[0] or 0
    levels = [made.filter(f"level >= {stored} or not open")]
    up = None
    for level in range(len(sizes(most)) - 1 if most else 0):
        here = made.filter(f"level = {level} and open").select("tree", "n", "idx", "digest")
        here = here if up is None else here.unionByName(up.filter(F.col("n") > FANIN**level).select(here.columns))
        digests = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"]), "")
        up = checkpoint(here.groupBy("tree", "n", F.expr(f"idx div {FANIN}").alias("idx")).agg(F.sha2(digests, 256).alias("digest")))
        levels.append(up.select("tree", "n", F.lit(level + 1).alias("level"), "idx", "digest", F.lit(False).alias("open")))
    nodes = levels[0]
    for x in levels[1:]:
        nodes = nodes.unionByName(x)
    reach = F.expr(f"shiftleft(1L, level * {FANIN.bit_length() - 1})")  # leaves below a node
    roots = checkpoint(nodes.filter((reach >= F.col("n")) & ((F.col("level") == 0) | (reach / FANIN < F.col("n")))).select("tree", "n", "digest"))
    return Forest(leaves, nodes.filter(F.col("level") >= stored).select("tree", "level", "idx", "digest"), roots, part)


def placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with pos and n, from 0 in each ``tree`` in the order of ``by``; rows alike in all of ``by`` may swap."""
    kept = checkpoint(rows).withColumn("__row", F.monotonically_increasing_id())  # spreads repeated rows over ranges
    ordered = numbered(kept, ["tree", *by, "__row"])
    trees = checkpoint(ordered.groupBy("tree").agg(F.min("ord").alias("__first"), F.count("*").alias("n")))
    return join_sized(ordered, trees, "tree", "inner", BROADCAST_ROWS).select(*rows.columns, (F.col("ord") - F.col("__first")).alias("pos"), "n")


def folded(leaf: Column, left: Column, right: Column) -> Column:
    """The root that a leaf's digest gives with its siblings."""
    return F.aggregate(F.arrays_zip(left.alias("left"), right.alias("right")), leaf, lambda at, x: F.sha2(F.concat(x["left"], at, x["right"]), 256))


def proof_digest(left: Column, right: Column) -> Column:
    """SHA-256 of all siblings, level by level, before and after."""
    return F.sha2(F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), ""), 256)


def manifest(docs: DataFrame, part: int = PART) -> DataFrame:
    """doc_id, lang, pos, leaf, claimed, left, right, subroot, root for each document.

    pos is the leaf's place in its language, by doc_id (null first), equal ids by digest; left and right hold the joined
    digests of the siblings at each level up to the root; claimed is the digest of the row as it may have been tampered
    with: where 3 divides the crc32 of doc_id, A-Z of the text in lower case. Nulls in any column are leaves like others, a
    null language is a language of its own before the others; repeated rows are a leaf each; an empty table has no rows.
    """
    lower = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", UPPER, LOWER))
    leaf, changed = leaf_digest(), leaf_digest(text=lower)
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree")  # null before all others
    rows = docs.select(tree, F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("digest"), F.when(lower.isNotNull(), changed).otherwise(leaf).alias("claimed"))
    own = forest(placed(rows, ["doc_id", "digest"]), part)
    heads = placed(own.roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), ["of"])
    above = forest(heads, part)
    top = above.roots.select(F.col("digest").alias("root"))
    heads = checkpoint(above.proofs().select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), F.col("left").alias("__left"), F.col("right").alias("__right")).crossJoin(F.broadcast(top)))  # one root
    out = join_sized(own.proofs(), heads, "tree", "inner", BROADCAST_ROWS)
    lang = F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1)).alias("lang")
    return out.select("doc_id", lang, "pos", F.col("digest").alias("leaf"), "claimed", F.concat("left", "__left").alias("left"), F.concat("right", "__right").alias("right"), "subroot", "root")


def audited(made: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified from what ``manifest`` gives."""
    root = folded(F.col("claimed"), F.col("left"), F.col("right"))
    out = made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("left"), F.col("right")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: SQL has no crc32: a table of 256 remainders, then a byte at a time.
_CRC = """crc(t) AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)))"""
SQL = f"""
WITH RECURSIVE {_CRC},
d AS (SELECT *, coalesce('=' || lang, '') AS tree, CASE WHEN xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS low,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM documents, crc),
h AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS claimed FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
n(tree, level, idx, digest, nodes) AS (SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM l
  UNION ALL SELECT tree, level + 1, idx, digest, count(*) OVER (PARTITION BY tree) FROM (SELECT tree, level, idx // 8 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest FROM n WHERE nodes > 1 GROUP BY tree, level, idx // 8)),
r AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM n WHERE nodes = 1),
m(level, idx, digest, nodes) AS (SELECT 0, pos, subroot, count(*) OVER () FROM r
  UNION ALL SELECT level + 1, idx, digest, count(*) OVER () FROM (SELECT level, idx // 8 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest FROM m WHERE nodes > 1 GROUP BY level, idx // 8)),
run AS (SELECT tree, level, idx // 8 AS run, list(digest ORDER BY idx) AS digests FROM n WHERE nodes > 1 GROUP BY ALL),
above AS (SELECT level, idx // 8 AS run, list(digest ORDER BY idx) AS digests FROM m WHERE nodes > 1 GROUP BY ALL),
p(doc_id, tree, leaf, pos, level, held, proof) AS (SELECT doc_id, tree, leaf, pos, 0, claimed, '' FROM l
  UNION ALL SELECT doc_id, tree, leaf, pos // 8, level + 1, sha256(coalesce(array_to_string(digests[:pos % 8], ''), '') || held || coalesce(array_to_string(digests[pos % 8 + 2:], ''), '')), proof || coalesce(array_to_string(digests[:pos % 8], ''), '') || coalesce(array_to_string(digests[pos % 8 + 2:], ''), '')
  FROM p JOIN run USING (tree, level) WHERE run.run = pos // 8),
b AS (SELECT doc_id, tree, leaf, held, proof FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, tree, leaf ORDER BY level DESC) AS k FROM p) WHERE k = 1),
q(doc_id, leaf, subroot, pos, level, held, proof) AS (SELECT doc_id, leaf, subroot, pos, 0, held, proof FROM b JOIN r USING (tree)
  UNION ALL SELECT doc_id, leaf, subroot, pos // 8, level + 1, sha256(coalesce(array_to_string(digests[:pos % 8], ''), '') || held || coalesce(array_to_string(digests[pos % 8 + 2:], ''), '')), proof || coalesce(array_to_string(digests[:pos % 8], ''), '') || coalesce(array_to_string(digests[pos % 8 + 2:], ''), '')
  FROM q JOIN above USING (level) WHERE above.run = pos // 8),
e AS (SELECT doc_id, leaf, subroot, held, proof, row_number() OVER (PARTITION BY doc_id, leaf ORDER BY level DESC) AS k FROM q)
SELECT doc_id, leaf, subroot, (SELECT digest FROM m WHERE nodes = 1) AS root, sha256(proof) AS proof_sha256, held AS folded_root, held = (SELECT digest FROM m WHERE nodes = 1) AS verified FROM e WHERE k = 1
"""
