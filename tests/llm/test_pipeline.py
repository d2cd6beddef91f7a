"""Each stage of the pipeline on its own input against brute force, and on odd tables."""

import tempfile
import time
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridweave.llm import queries, wide_simhash
from gridweave.llm._text import mix
from test_operators import ODD, brute_lines, components, documents, sha  # noqa: F401

stages = dict(corpus_pipeline.STAGES)


def five(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


def test_quality_keeps_what_the_query_accepts(spark, docs, sf_dir):
    got = stages["quality"](spark, docs, sf_dir)
    assert got.columns == docs.columns
    good = {r.doc_id for r in queries.op2_quality(spark, sf_dir).filter("predicted = 1").collect()}
    assert {r.doc_id for r in got.collect()} == good and len(good) > 100


def test_lines_are_dropped_from_texts(spark, docs, sf_dir):
    got = stages["line_dedup"](spark, docs, sf_dir)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i: s for i, _, _, s in brute_lines(rows, 10)}
    for r in got.collect():
        assert sha(r.text) == want[r.doc_id] and r.n_chars == len(r.text)


def test_one_near_copy_stays(spark, docs, sf_dir):
    rows = {r.doc_id: five(r.text) for r in docs.collect()}
    similar = {(a, b): jaccard(rows[a], rows[b]) for a, b in combinations(sorted(rows), 2)}
    sure = components(sorted(rows), lambda a, b: similar[a, b] >= 0.85)
    may = components(sorted(rows), lambda a, b: similar[a, b] >= 0.72)
    got = stages["near_dedup"](spark, docs, sf_dir)
    assert got.columns == docs.columns
    left = {r.doc_id for r in got.collect()}
    assert {i for i, c in may.items() if i == c} <= left <= {i for i, c in sure.items() if i == c}


def edited(words, rng, n):
    out = list(words)
    for i in rng.choice(len(out), n, replace=False):
        out[i] = f"edit{rng.integers(10**9)}"
    return out


def test_similar_texts_are_found_and_others_are_not(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, groups = [], {}
    for g in range(120):
        base = [vocabulary[i] for i in rng.integers(0, 3000, int(rng.integers(60, 600)))]
        for copy in range(4):
            rows.append((g * 10 + copy, " ".join(base if not copy else edited(base, rng, max(1, len(base) * copy // 150)))))
    pairs = {(a, b): jaccard(five(s), five(t)) for (a, s), (b, t) in combinations(rows, 2) if a // 10 == b // 10}
    groups = {r.doc_id: r.component_id for r in wide_simhash.similar_groups(documents(spark, rows)).collect()}
    due = [p for p, j in pairs.items() if j >= 0.8]
    found = [p for p in due if groups[p[0]] == groups[p[1]]]
    assert len(due) > 200 and len(found) >= 0.97 * len(due)
    assert all(i // 10 == c // 10 for i, c in groups.items())
    may = components([i for i, _ in rows], lambda a, b: pairs.get((a, b), 0) >= 0.8)
    assert all(may[i] == may[c] for i, c in groups.items())


def test_near_copies_of_real_documents_against_all_pairs(spark, sf_dir):
    """Every pair of different texts by an index of shingles: recall at 0.8, and nobody linked by less."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: five(r.text or "") for r in docs.collect()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter(p for ids in holders.values() for p in combinations(sorted(ids), 2))
    due = {(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)}
    groups = {r.doc_id: r.component_id for r in wide_simhash.similar_groups(docs).collect()}
    assert len(due) >= 10 and sum(groups[a] == groups[b] for a, b in due) >= 0.95 * len(due)
    may = components(sorted(sets), lambda a, b: (a, b) in due)
    assert all(may[i] == may[c] for i, c in groups.items() if sets[i])


def test_no_similar_pair_is_left_to_chance(spark):
    """Pairs just above and just below 0.8: all of the first are linked, none of the second; fingerprints alone miss some."""
    rng = np.random.default_rng(7)
    rows = []
    for g in range(500):
        base = [f"g{g}x{i}" for i in range(int(rng.integers(100, 160)))]
        # a run of k new words changes k + 4 shingles of the m
        m = len(base) - 4
        k = (m - (m * 8 + 8) // 9) - 4 + g % 2  # for odd g one more than 0.8 allows
        other = list(base)
        other[20 : 20 + k] = [f"g{g}y{i}" for i in range(k)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    groups = {r.doc_id: r.component_id for r in wide_simhash.similar_groups(documents(spark, rows)).collect()}
    due = {2 * g for g in range(500) if jaccard(five(rows[2 * g][1]), five(rows[2 * g + 1][1])) >= 0.8}
    assert 200 <= len(due) <= 300 and {i for i in range(0, 1000, 2) if groups[i + 1] == i} == due


def test_long_blocks_leave_no_similar_pair_to_chance(spark, monkeypatch):
    """Blocks as for 67 million texts meet less often and are no more in number; the exact way finds the rest."""
    assert {n: wide_simhash.shape(n) for n in (10**6, 5 * 10**6, 6 * 10**7)} == {10**6: (20, 16), 5 * 10**6: (21, 16), 6 * 10**7: (24, 16)}
    monkeypatch.setattr(wide_simhash, "shape", lambda n: (24, 16))
    test_no_similar_pair_is_left_to_chance(spark)


def test_steps_leave_no_shuffle_files(spark):
    """A stage leaves what its last join has at most, not what its steps have shuffled."""
    own = lambda: {p: p.stat().st_size for p in Path(tempfile.gettempdir()).glob("blockmgr-*/*/shuffle_*.data")}
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 5000, 200))) for i in range(600)]
    texts = documents(spark, rows).cache()
    before = own()
    assert stages["near_dedup"](spark, texts, None).count() == 600
    for _ in range(50):  # files go a moment after the step
        left = sum(n for p, n in own().items() if p not in before)
        if left < 100_000:
            break
        time.sleep(0.2)
    assert left < 100_000, left


def test_opening_shingles_meet_in_any_order_and_parities_bound_differences():
    rng = np.random.default_rng(8)
    for _ in range(300):
        both, own = int(rng.integers(4, 400)), rng.integers(0, 40, 2)
        pool = rng.integers(0, 2**63, both + 80).astype(np.uint64)
        x, y = np.unique(np.concatenate([pool[:both], pool[both : both + own[0]]])), np.unique(np.concatenate([pool[:both], pool[both + 40 : both + 40 + own[1]]]))
        common = np.sort(rng.choice(pool, 50, replace=False))
        apart = len(np.setxor1d(x, y))
        assert np.bitwise_count(wide_simhash.parity(x) ^ wide_simhash.parity(y)).sum() <= apart
        if both >= 0.8 * (both + own.sum()) - 1e-9:
            assert apart <= wide_simhash.differing(len(x), len(y), 0.8)
            assert len(np.intersect1d(wide_simhash._opening(x, common, 0.8), wide_simhash._opening(y, common, 0.8)))
        else:
            assert apart > wide_simhash.differing(len(x), len(y), 0.8)


@pytest.mark.parametrize(("width", "step"), [(20, 16), (24, 8), (32, 4), (23, 8)])
def test_blocks_are_bits_of_the_fingerprint(width, step):
    wide = np.random.default_rng(2).integers(0, 2**63, (3, 32)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7]), pa.array([r.tobytes() for r in wide], pa.binary())], ["node", "wide"])
    (got,) = wide_simhash._blocks([batch], width, step)
    keys = got["key"].to_numpy().reshape(3, -1)
    for row in range(3):
        whole = int.from_bytes(wide[row].tobytes(), "little")
        whole |= whole << 2048  # blocks at the end go on at the beginning
        assert [int(k) for k in keys[row]] == [(whole >> i * step & (2**width - 1)) | i << 32 for i in range(2048 // step)]


def test_blocks_widen_with_the_number_of_texts():
    assert wide_simhash.shape(1000) == (20, 16) and wide_simhash.shape(10**7)[0] == 22 and wide_simhash.shape(10**12) == (32, 4)
    assert all(n / 2 ** wide_simhash.shape(n)[0] <= 4 for n in (1, 10**6, 10**8, 10**10))


def test_crowded_blocks_are_judged_in_pieces(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(400)]
    other = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(edited(base if i % 2 else other, rng, 3))) for i in range(2, 602)]
    groups = {r.doc_id: r.component_id for r in wide_simhash.similar_groups(documents(spark, rows), limit=16).collect()}
    assert groups == {i: 3 if i % 2 else 2 for i, _ in rows}


def test_odd_texts_have_groups(spark):
    long = " ".join(f"w{i}" for i in range(600_000))
    rows = [*ODD, (20, long), (21, long.upper() + " end"), (None, None)]
    got = {r.doc_id: r.component_id for r in wide_simhash.similar_groups(documents(spark, rows)).collect()}
    assert got[21] == got[20] == 20 and got[7] == got[1] == 1 and got[3] == got[4] == 2 and got[None] in (2, None) and got[9] == 9 and got[5] == 5
    assert wide_simhash.similar_groups(documents(spark, rows[:1]).limit(0)).count() == 0


def test_a_wide_bit_is_the_majority_of_mixed_hashes():
    hashes = np.random.default_rng(1).integers(0, 2**63, 700).astype(np.uint64)
    wide = wide_simhash.wide_fingerprint(hashes)
    mixed = mix(hashes[:, None] ^ mix(np.arange(1, 33, dtype=np.uint64)))
    for word, bit in ((0, 0), (3, 17), (31, 63)):
        ones = sum(int(x) >> bit & 1 for x in mixed[:, word])
        assert int(wide[word]) >> bit & 1 == (ones * 2 > 700)


def test_contaminated_documents_go(spark, docs, sf_dir):
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    holds = {r.doc_id for r in docs.collect() if any(i in r.text for i in items)}
    left = {r.doc_id for r in stages["decontamination"](spark, docs, sf_dir).collect()}
    assert holds and not holds & left and len(left) >= docs.count() - len(holds) - 3


def test_rows_that_share_an_id_are_judged_by_their_texts(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    a, b, c = ("the river froze over early that year", "a new bridge opens to walkers in spring", "bakers rise before the town wakes up")
    df = documents(spark, [(1, a), (5, a), (5, b), (None, a), (None, c), (6, c), (7, item), (7, "soon " + b + " and summer"), (None, item)])
    left = stages["near_dedup"](spark, df, sf_dir)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, a), (5, b), (6, c), (7, item), (7, "soon " + b + " and summer")], key=str)
    left = stages["decontamination"](spark, df, sf_dir)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, a), (5, a), (5, b), (None, a), (None, c), (6, c), (7, "soon " + b + " and summer")], key=str)


def test_one_of_repeated_rows_stays(spark, sf_dir):
    a, b = "the river froze over early that year", "a new bridge opens to walkers in spring"
    rows = [(1, a), (1, a), (2, a), (None, b), (None, b), (None, b + " "), (3, None), (3, None), (3, "")]
    df = documents(spark, rows).withColumn("lang", F.when(F.rand(1) < 0.5, "en"))
    left = [(r.doc_id, r.text or "") for r in stages["near_dedup"](spark, df, sf_dir).collect()]
    assert len(left) == 3 and (1, a) in left and (3, "") in left and sum(i is None for i, _ in left) == 1


def test_the_whole_pipeline(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 50 < got.count() < 200


def test_stages_take_odd_rows(spark, sf_dir):
    df = documents(spark, ODD)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), sf_dir).count() == 0
        df = stage(spark, df, sf_dir)
    assert df.count() > 0
