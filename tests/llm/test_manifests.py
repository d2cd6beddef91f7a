"""Packing, the source audit and the Merkle manifest against brute force and SQL, and on odd tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_operators import HARD, documents, oracle, same
from tokenizers import Tokenizer

from gridweave.llm import bpe, divergence, merkle, packing, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, level string, n long"


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.tokenizer_path())


def full_rows(spark, rows):
    """rows: (doc_id, text, lang, source, n_chars); the extra columns have names that the operators use."""
    return spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA)


# packing


def hold(rows, docs, library, capacity=packing.CAPACITY):
    """Checks pieces against whole texts (doc_id, text), and returns ids wasted and ids packed."""
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids + [packing.END]) for i, t in docs]
    want = Counter((i, zlib.crc32(np.array(x[s : s + capacity], np.uint32).tobytes()), s, len(x[s : s + capacity]), len(x)) for i, x in ids for s in range(0, len(x), capacity))
    assert Counter((r["doc_id"], r["ids_crc32"], r["start"], r["length"], r["doc_tokens"]) for r in rows) == want
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    wasted = 0
    for w in windows.values():
        end = 0
        for offset, length in sorted(w):
            assert offset == end
            end += length
        assert 0 < end <= capacity
        wasted += 0 if end & (end - 1) == 0 else capacity - end
    return wasted, sum(r["length"] for r in rows)


def test_packing_holds_every_id_once(spark, real, library):
    rows = real.select("doc_id", "text").collect()
    wasted, packed = hold(packing.pack(real, queries.tokenizer_path()).collect(), rows, library)
    assert wasted < 0.05 * packed


def test_packing_odd_rows_and_small_windows(spark, library):
    rows = [*HARD, (20, "x <|endoftext|>y<|startoftext|>"), (21, "<|ENDOFTEXT|> \x1c\x1d'S it's ΑΣ İ ① 日本語"), (22, "\x85a\xa0b\x00c")]
    short = [r for r in rows if len(r[1] or "") < 6000]
    for capacity, some in ((4096, rows), (64, short), (1, short[:9])):
        wasted, packed = hold(packing.pack(documents(spark, some), queries.tokenizer_path(), capacity).collect(), some, library, capacity)
        assert wasted < 0.2 * packed or capacity == 4096
    assert packing.pack(documents(spark, []), queries.tokenizer_path()).count() == 0


def test_packing_in_groups_and_assembled(spark, real, library, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 40_000)
    pieces = packing.pack(real, queries.tokenizer_path(), ids=True).cache()
    hold(pieces.collect(), real.select("doc_id", "text").collect(), library)
    whole = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    assert sum(r.length for r in whole.values()) == sum(len(r.ids) // 4 for r in whole.values())
    for p in pieces.collect():
        r = whole[p.sequence_id]
        assert r.ids[4 * p.offset : 4 * (p.offset + p.length)] == p.ids and zlib.crc32(p.ids) == p.ids_crc32
        assert r.padding == (0 if r.length & (r.length - 1) == 0 else 4096 - r.length)


def test_differencing_is_near_equal():
    rng = np.random.default_rng(4)
    for n, k in ((1, 1), (3, 5), (40, 7), (700, 60), (2000, 3)):
        sizes = rng.integers(1, 4096, n)
        window = packing.differencing(sizes, k)
        sums = np.bincount(window, sizes, k)
        assert window.min() >= 0 and window.max() < k and sums.sum() == sizes.sum()
        assert np.ptp(sums) <= sizes.max()
        if n >= 10 * k:
            assert np.ptp(sums) <= 300
    sizes = np.array([8, 7, 6, 5, 4])  # differences 1, 1, 4; 3, 1; 2
    assert sorted(np.bincount(packing.differencing(sizes, 2), sizes).tolist()) == [14, 16]


def test_the_number_of_windows_rises_beyond_capacity():
    window, k = packing.near_equal(np.array([3, 3, 2]), 4)
    assert k == 3 and sorted(window.tolist()) == [0, 1, 2]
    assert packing.near_equal(np.array([4, 4]), 4)[1] == 2


def test_ids_are_the_librarys_when_the_store_is_cleared(library, monkeypatch):
    monkeypatch.setattr(packing, "STORE", 3)
    encoder = packing.TextIds(bpe.load(queries.tokenizer_path()))
    for texts in (["one two three", "", "Ünïcode naïve　x"], ["one four's 12 <|endoftext|>", "a\x1eb"]):
        assert [x.tolist() for x in encoder.of(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


# divergence


def brute_audit(rows, min_docs, top=50):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = "".join(c if c >= "\x80" or "a" <= c <= "z" else " " for c in low).split(" ")
        words = [w for w in words if w]
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        own = {s: c for (g, s), c in groups.items() if g == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in own.items()}, share(sum(own.values(), Counter()))
        for s in own:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, o, v, i + 1) for i, (v, o) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(out)


def audit_rows(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + ["É", "日本", "zz\u0085z", "Ｚ"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60) + 1, p=None)).upper() + ", 12 x-y_z", rng.choice(["de", "en", "fr"]), f"s{rng.integers(0, 11)}", 1) for i in range(150)]
    rows += [(200, None, None, None, None), (201, "", None, "a", 0), (201, "", None, "a", 0), (202, "x", "lone", "only", 1), (None, "wAa wba", "en", None, 1), (203, "É" * 50_000, "en", "s1", 1), (204, "waa " * 30_000, "en", "s1", 1)]
    return rows


@pytest.mark.parametrize(("block", "min_docs"), [(64, 5), (3, 2), (1, 60)])
def test_audit_matches_brute_force(spark, monkeypatch, block, min_docs):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = audit_rows(block)
    got = [tuple(r) for r in divergence.audit(full_rows(spark, rows).repartition(5), min_docs).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == brute_audit(rows, min_docs)


def test_audit_matches_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    same(divergence.audit(docs).toPandas(), oracle(divergence.SQL, documents=docs.toPandas()))


def test_audit_of_long_texts_and_none(spark):
    assert divergence.audit(documents(spark, HARD), 1).filter("part = 'pair'").count() == 0
    assert divergence.audit(documents(spark, [])).count() == 0


def test_columns_are_run_length_encoded(spark):
    rows = [(i, " ".join(f"t{chr(97 + j)}" for j in range(26)), "en", s, 1) for i in range(40) for s in "ab"]
    made = divergence.Audit(full_rows(spark, rows))
    columns = made.columns().collect()
    assert sum(r.rows for r in columns if r.source == "a") == 26 and all(len(r.starts) == 8 for r in columns)  # equal counts are one run


# Merkle manifest


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def brute_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars) to what the query returns."""
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*map(code, (r[0], r[3], r[2], r[4], text)))
    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def tree(level):
        levels = [level]
        while len(level) > 1:
            level = [H(*level[i : i + 8]) for i in range(0, len(level), 8)]
            levels.append(level)
        return levels

    def siblings(levels, i):
        for level in levels[:-1]:
            start = i // 8 * 8
            yield level[start:i], level[i + 1 : start + 8]
            i //= 8

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {x: tree([leaf(r, r[1]) for r in by[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(by[x]):
            proof = [*siblings(trees[x], i), *siblings(top, k)]
            at = leaf(r, lower(r[1]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[1])
            for a, b in proof:
                at = H(*a, at, *b)
            out.append((r[0], trees[x][0][i], trees[x][-1][0], top[-1][0], H(*(d for a, b in proof for d in a + b)), at, at == top[-1][0]))
    return Counter(out)


ORDER = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest_of(spark, rows, part):
    docs = full_rows(spark, rows).repartition(7)
    return Counter(tuple(r) for r in merkle.audited(merkle.manifest(docs, part)).select(ORDER).collect())


@pytest.mark.parametrize("part", [8, 64, 4096])
def test_manifest_matches_brute_force(spark, part):
    rng = np.random.default_rng(part)
    rows = [(int(i) - 40, f"Text {i}" if i % 9 else None, [None, "", "de", "en", "en", "en", "日"][rng.integers(0, 7)], f"s{i}" if i % 5 else None, int(i) if i % 4 else None) for i in rng.permutation(700)]
    rows += [(7, "Same", "en", "s", 4)] * 30 + [(None, "A", "en", None, None), (None, None, None, None, None), (9, "X" * 300_000, "one", "s", 1)]
    assert manifest_of(spark, rows, part) == brute_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_manifest_of_one_language(spark, n):
    rows = [(i, f"T{i}", "en", None, i) for i in range(n)]
    assert manifest_of(spark, rows, 8) == brute_manifest(rows)


def test_manifest_of_many_languages_and_of_none(spark):
    rows = [(i, "Ab", f"l{i % 70}", "s", i) for i in range(150)]
    assert manifest_of(spark, rows, 8) == brute_manifest(rows)
    assert merkle.audited(merkle.manifest(documents(spark, []))).count() == 0
    assert merkle.manifest(documents(spark, HARD)).count() == len(HARD)


def test_manifest_matches_sql(spark, real):
    same(merkle.audited(merkle.manifest(real)).toPandas(), oracle(merkle.SQL, documents=real.toPandas()))


def test_missing_nodes_are_the_fewest():
    """What proofs of an interval need, less what the interval and the missing nodes give."""
    for n in (1, 8, 9, 100, 513):
        for first, last in ((0, 0), (3, 20), (0, n - 1), (n // 2, n - 1)):
            if last >= n or first > last:
                continue
            asked = merkle.missing(n, first, last)
            have, need = {(0, i) for i in range(first, last + 1)} | set(asked), set()
            for pos in range(first, last + 1):
                at = pos
                for level, nodes in enumerate(merkle.sizes(n)[:-1]):
                    need |= {(level, i) for i in range(at // 8 * 8, min(at // 8 * 8 + 8, nodes)) if i != at}
                    at //= 8
            known = set(have)
            for level, nodes in enumerate(merkle.sizes(n)[:-1]):
                known |= {(level + 1, r) for r in range(-(-nodes // 8)) if all((level, i) in known for i in range(r * 8, min(r * 8 + 8, nodes)))}
            assert need <= known
            for node in asked:  # none is of the interval's own subtrees
                assert node in need and not first // 8 ** node[0] <= node[1] <= last // 8 ** node[0]
            assert len(asked) == len(set(asked))
