"""The ten operators against brute force, exact round trips and SQL, and on odd tables."""

import hashlib
import re
import tempfile
import time
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gridweave.llm import bpe, chat, decontam, exact_dedup, html_extract, line_dedup, lm_scoring, quality, queries, simhash, substring_dedup
from gridweave.llm import _spark as helpers

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, rows):
    """rows: (doc_id, text); extra columns clash with the operators' own names."""
    return spark.createDataFrame([(i, t, None, None, None, "x", None) for i, t in rows], DOCS)


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    return con.sql(sql).df()


def same(df, frame):
    cols = sorted(df.columns)
    assert sorted(frame.columns) == cols
    a, b = (x[cols].sort_values(cols).reset_index(drop=True).astype(str) for x in (df, frame))
    assert len(a) == len(b)
    assert a.equals(b), (a[(a != b).any(axis=1)].head(), b[(a != b).any(axis=1)].head())


ODD = [(1, "a b\tc\n\nA  b c"), (2, None), (3, ""), (4, " \n\x0b "), (5, "x" * 5000), (6, "Σ É é \x1c z"), (7, "a b\tc\n\nA  b c"), (8, "one two"), (None, "a b c"), (9, "same"), (9, "same"), (10, "w " * 3000)]


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


# exact duplicates


def test_exact_matches_sql(spark, real):
    same(exact_dedup.exact_duplicates(real).toPandas(), oracle(queries.EXACT_SQL, documents=real.toPandas()))


def test_exact_odd_rows(spark):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_duplicates(documents(spark, ODD)).collect()}
    assert got[7, sha("a b c A b c")].keep_id == 1 and not got[7, sha("a b c A b c")].kept
    assert got[2, sha("")].keep_id == 2 and got[3, sha("")].group_size == 2
    assert got[4, sha(" ")].kept and got[None, sha("a b c")].kept
    assert exact_dedup.exact_duplicates(documents(spark, [])).count() == 0


def test_exact_survives_digest_clashes(spark):
    def bad(text):
        return F.unhex(F.substring(F.sha2(text, 256), 1, 2))

    rows = [(i, f"text {i % 150}") for i in range(600)]
    got = exact_dedup.exact_duplicates(documents(spark, rows), digest=bad).collect()
    assert len(got) == 600
    assert all(r.keep_id == r.doc_id % 150 and r.group_size == 4 for r in got)


def test_index_judges_batches_and_reads_few_runs(spark):
    index = exact_dedup.DigestIndex(spark, fanout=3)
    batches = [[(5, "a"), (6, "b"), (7, "b")], [(2, "a"), (9, "c")], [(20, "d"), (None, "e")], [(1, "b"), (30, " c"), (31, "c"), (32, "e")], [(33, "z")]]
    reads, seen = [], []
    for rows in batches:
        got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in index.add(documents(spark, rows)).collect()}
        seen += rows
        want = {}
        for i, t in rows:
            same_text = [k for k, u in seen if u == t]
            keep = min((k for k in same_text if k is not None), default=None)
            want[i, sha(t)] = (keep, len(same_text), i == keep)
        assert got == want
        reads.append([r.batches for r in index.read])
    assert reads == [[], [(0,)], [], [(0, 1, 2)], []]  # batch 2 is new to both runs' filters; three runs became one
    assert [(r.level, r.batches) for r in index.runs] == [(2, (0, 1, 2)), (1, (3,)), (1, (4,))] and len(index.replaced) == 3


def test_index_settles_clashes_with_older_batches(spark):
    index = exact_dedup.DigestIndex(spark, digest=lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1)))
    index.add(documents(spark, [(i, f"text {i}") for i in range(40)]))
    got = index.add(documents(spark, [(100 + i, f"text {i * 2}") for i in range(40)])).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(100 + i, i * 2 if i < 20 else 100 + i, 2 if i < 20 else 1) for i in range(40)}


# lines


def brute_lines(rows, min_docs):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\f\r"))
    docs = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            docs[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not key(x) or len(docs[key(x)]) < min_docs]
        out.append((i, len(lines), len(lines) - len(keep), sha("\n".join(keep))))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs", [2, 3, 10])
def test_lines_match_brute_force(spark, min_docs):
    rng = np.random.default_rng(min_docs)
    rows = [(i, "\n".join(f" Line {rng.integers(12) ** 2}\t" for _ in range(rng.integers(1, 6)))) for i in range(200)] + ODD + [(1000 + i, "hot\nhot") for i in range(300)]
    got = line_dedup.line_bitmaps(documents(spark, rows), min_docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows, min_docs)


def test_line_stream_over_partition_edges():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    rows = sorted({(int(h), 1, int(d), int(p)) for h, d, p in zip(rng.integers(0, 6, 400), rng.integers(0, 60, 400), rng.integers(0, 3, 400), strict=True)})
    table = np.array([(*r, 0) for r in rows])
    for cuts in ([], [100], [5, 6, 7, 200], [50, 100, 150, 250, 300]):
        sure, held, extra = set(), [], Counter()
        for part in np.split(table, [next(i for i in range(c, len(table)) if tuple(table[i, :3]) != tuple(table[i - 1, :3])) for c in cuts]):
            batches = [pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(b[:, i])) for i in range(5)], ["h1", "h2", "rid", "pos", "th"]) for b in np.array_split(part, 4) if len(b)]
            for out in line_dedup._stream(batches, 20):
                for r in out.to_pylist():
                    if r["sure"]:
                        sure.add((r["h1"], r["rid"], r["pos"]))
                    else:
                        extra[r["h1"]] += r["docs"]
                        held.append((r["h1"], r["rid"], r["pos"]))
        got = sure | {x for x in held if extra[x[0]] >= 20 and x[2] >= 0}
        docs = defaultdict(set)
        for h, _, d, _p in rows:
            docs[h].add(d)
        assert got == {(h, d, p) for h, _, d, p in rows if len(docs[h]) >= 20}


def test_bitmaps_round_trip():
    keep = np.random.default_rng(1).random(1000) > 0.5
    assert (line_dedup.unpacked_bitmap(line_dedup.packed(keep), 1000) == keep).all()


# substrings


def brute_repeats(rows, n):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - n + 1):
            if first.setdefault(tuple(w[p : p + n]), (i, p)) != (i, p):
                gone |= set(range(p, p + n))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("n", [3, 8, 20])
def test_repeats_match_brute_force(spark, n):
    rng = np.random.default_rng(n)
    base = [" ".join(rng.choice(list("abcdefgh"), 60)) for _ in range(20)]
    rows = [(i, " ".join(rng.choice(list("abcd"), 30)) + " " + base[rng.integers(20)][: rng.integers(1, 120)] + "\n" + base[0][:60]) for i in range(150)]
    rows += [(1000, "z " * 500), (1001, None), (1002, ""), (1003, "a b"), (1004, base[3])] + [(2000 + i, base[5]) for i in range(400)]
    got = substring_dedup.drop_repeats(documents(spark, rows), n).drop("kept_text").collect()
    assert sorted(map(tuple, got)) == brute_repeats(rows, n)


def test_repeats_of_lengthened_prefixes(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HEAVY", 16)
    rng = np.random.default_rng(4)
    rows = [(int(i), " ".join(rng.choice(list("abc"), 12)) + " p q r s t u v w x y z " * (1 + i % 3)) for i in rng.permutation(300)]
    got = substring_dedup.drop_repeats(documents(spark, rows), 8).drop("kept_text").collect()
    assert sorted(map(tuple, got)) == brute_repeats(rows, 8)


def test_repeats_of_periodic_texts(spark):
    rows = [(1, "a " * 60_000), (2, "b " + "a " * 30_000), (3, ("x y z " * 9 + "q ") * 3_000), (4, "x y z " * 50), (5, "a " * 30), (None, "a " * 5_000)]
    got = substring_dedup.drop_repeats(documents(spark, rows)).drop("kept_text").collect()
    want = brute_repeats([(-(2**63) if i is None else i, t) for i, t in rows], 20)
    assert sorted((-(2**63) if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == want
    with pytest.raises(ValueError):
        substring_dedup.drop_repeats(documents(spark, rows), 64)


def test_subtrees_compare_words():
    """Suffixes with one hash and other words: no window of theirs is a repeat."""
    rows = [(0, 0, i, 0, 0, 256, b"a b c %d e" % (i % 2)) for i in range(4)] + [(1, 0, 9, 0, 5, 2 * 256 + 1, b"f a b c d e")] * 2
    table = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), substring_dedup._SUFFIXES.types, strict=True)], schema=substring_dedup._SUFFIXES)
    out = pa.Table.from_batches(substring_dedup._subtrees([table], 5)).to_pylist()
    assert sorted((r["rid"], r["start"], r["mask"]) for r in out) == [(2, 0, 1), (3, 0, 1)]


def test_repeats_odd_rows(spark):
    got = substring_dedup.drop_repeats(documents(spark, ODD), 3).collect()
    assert len(got) == len(ODD)
    assert {r.n_removed for r in got if r.doc_id == 9} == {0}
    assert substring_dedup.drop_repeats(documents(spark, [])).count() == 0


# near duplicates


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(nodes, linked):
    parent = {i: i for i in nodes}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in nodes}


def test_simhash_matches_brute_force(spark, real):
    rows = [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()] + [(10_000, None), (10_001, ""), (10_002, "Two words"), (10_003, "two WORDS")]
    prints = {i: brute_fingerprint(t) for i, t in rows}
    want = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{prints[i]:016x}", want[i]) for i in prints}


@pytest.mark.parametrize("limit", [4, 2048])
def test_links_in_crowded_blocks(spark, limit):
    rng = np.random.default_rng(limit)
    fps = {0, 2**64 - 1}
    for base in rng.integers(0, 2**63, 6):
        for _ in range(25):
            x = int(base)
            for b in rng.choice(12, rng.integers(0, 7), replace=False):
                x ^= 1 << int(b) * 3
            fps.add(x)
    signed = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    want = components(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), limit)
    got = {r.node: r.component for r in helpers.connected_components(found).collect()}
    assert {x: got.get(x, x) for x in signed} == want


def test_long_runs_stream_to_finer_blocks():
    fps = np.arange(150_000)
    small = np.array([5, 7])

    def batches():
        for mask, own in ((1, small), (2, fps), (3, small)):
            for i in range(0, len(own), 10_000):
                x = pa.array(own[i : i + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), mask)), pa.array(np.zeros(len(x), np.int64)), x], ["mask", "key", "fp"])

    out = pa.Table.from_batches(simhash._link(batches(), 2048)).to_pandas()
    finer = out[out["mask"].notna()]
    assert len(finer) == len(fps) * 20 and set(finer["a"]) == set(fps.tolist()) and not finer.duplicated(["a", "mask"]).any()
    assert out[out["mask"].isna()][["a", "b"]].values.tolist() == [[5, 7], [5, 7]]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.node: r.component for r in helpers.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(50)} == {100} and got[300] == 299
    assert helpers.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# language models


def test_scores_match_sql(spark, real, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = queries.op1_lm_scoring(spark, sf_dir).toPandas()
    same(got, oracle(lm_scoring.SQL, documents=real.toPandas(), labels=labels.toPandas()))


def test_scores_of_odd_rows_match_sql(spark):
    rows = [*ODD, *((20 + i, "the cat sat on the mat " * (1 + i)) for i in range(5)), (20, "the dog"), (None, "the cat")]
    labels = spark.createDataFrame([(20, 1, 0), (20, 0, 0), (21, 1, 0), (9, 1, 0), (1, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    for own in (labels, labels.limit(0)):
        got = lm_scoring.score(docs, own).toPandas()
        for c in ("target_loss", "background_loss", "loss_difference"):
            got[c] = got[c].round(6) + 0.0
        want = oracle(lm_scoring.SQL, documents=docs.toPandas().astype({"doc_id": "Int64"}), labels=own.toPandas().astype({"doc_id": "Int64"}))
        got["doc_id"], want["doc_id"] = (x["doc_id"].astype("Int64") for x in (got, want))
        columns = ["doc_id", "n_tokens", "target_loss", "background_loss", "loss_difference"]
        a, b = (sorted(map(tuple, x[columns].astype(object).where(x[columns].notna(), None).values.tolist()), key=str) for x in (got, want))
        assert [r[:2] for r in a] == [r[:2] for r in b] and np.allclose([r[2:] for r in a], [r[2:] for r in b], atol=2e-6)
    assert lm_scoring.score(documents(spark, []), labels).count() == 0


def test_scores_count_every_word_and_bigram(spark):
    """Many different words, in few and in many buckets, against the model's formula."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{k}" for k in np.concatenate([rng.integers(0, 60_000, 900), rng.integers(0, 50, 100)]))) for i in range(60)] + [(None, "w1 w2"), (70, None), (71, "W1 w1 w1")]
    labels = spark.createDataFrame([(i, int(i < 9), 0) for i in range(20)], "doc_id long, quality int, toxic int")
    sides = []
    for part in ([t for i, t in rows if i is not None and i < 9], [t for _, t in rows]):
        pairs = [p for t in part for w in [(t or "").lower().split()] for p in zip([None, *w], w, strict=False)]
        sides.append((Counter(pairs), Counter(u for u, _ in pairs), Counter(w for _, w in pairs)))
    size = len(sides[1][2]) + 1
    assert size > 32_768

    def loss(side, text):
        two, context, word = side
        w = text.lower().split()
        p = [(0.7 * two[u, v] / context[u] + 0.3 * (word[v] + 1) / (word.total() + size)) if context[u] else (word[v] + 1) / (word.total() + size) for u, v in zip([None, *w], w, strict=False)]
        return -np.log(p).sum() / max(1, len(w))

    want = sorted((str(i), len((t or "").split()), *(round(loss(s, t or ""), 6) + 0.0 for s in sides)) for i, t in rows)
    for bucket_bytes in (lm_scoring.BUCKET_BYTES, 1_000):
        got = lm_scoring.score(documents(spark, rows), labels, bucket_bytes=bucket_bytes).collect()
        got = sorted((str(r.doc_id), r.n_tokens, r.target_loss, r.background_loss) for r in got)
        assert [g[:2] for g in got] == [x[:2] for x in want]
        assert np.allclose([g[2:] for g in got], [x[2:] for x in want], atol=2e-6)


def test_scores_leave_one_shuffle_at_most(spark):
    """Questions and lists of words are dropped before the answers travel."""
    own = lambda: {(p.parts[-3], p.name.split("_")[1]) for p in Path(tempfile.gettempdir()).glob("blockmgr-*/*/shuffle_*.data") if p.stat().st_size > 100_000}
    rng = np.random.default_rng(6)
    docs = documents(spark, [(i, " ".join(f"w{k}" for k in rng.integers(0, 60_000, 900))) for i in range(100)])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    before = own()
    assert lm_scoring.score(docs, labels).count() == 100
    for _ in range(50):  # files go a moment after the step
        left = own() - before
        if len(left) <= 1:
            break
        time.sleep(0.2)
    assert len(left) <= 1, left


# quality


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op2_quality(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (5, None, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(documents(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(documents(spark, []), labels).count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, rounds=20, pairs=1)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


# html


def article_text(html):
    import html as entities

    inner = re.search(r"<article>(.*?)(?:</article>|$)", html, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    clean = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<br>|</?b>", " ", b).replace("  ", " "))).strip() for b in blocks]
    return "\n".join(b for b in clean if b)


def test_main_text_of_real_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: article_text(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    assert got == want


def test_main_text_of_made_pages():
    rng = np.random.default_rng(99)
    texts = [" ".join(rng.choice("lorem ipsum dolor sit amet consectetur adipiscing elit".split(), rng.integers(6, 40))) + "." for _ in range(200)]
    model = html_extract.fit(["<body><article><p>" + "</p><p>".join(texts[:30]) + "</p></article></body>"], made=500)
    right = total = 0
    for _ in range(150):
        html, = [html_extract.training_page(rng, texts)]
        page = html_extract.parse(html)
        want = [t.replace("", "") for _, t, _ in page.blocks if "" in t]
        page.blocks = [(n, t.replace("", ""), k) for n, t, k in page.blocks]
        got = model.texts([page])[0].split("\n")
        overlap = sum((Counter(want) & Counter(got)).values())
        right += 2 * overlap
        total += len(want) + len([g for g in got if g])
    assert right / total > 0.9, right / total


def test_decoding_is_hierarchical():
    page = html_extract.parse("<body><div><p>a</p><p>b</p></div><nav><p>c</p></nav></body>")
    open_ = html_extract.decode(page, np.random.default_rng(0).normal(size=len(page.nodes)))
    assert all(open_[x.parent] or not open_[i] for i, x in enumerate(page.nodes) if x.parent >= 0)


def test_parsing_of_unclosed_and_foreign_elements():
    import time

    text = lambda html: "\n".join(t for _, t, _ in html_extract.parse(html).blocks)
    assert text("<head><title>t</title><meta a=b><p>one<p>two") == "one\ntwo"
    assert text("<html><head>  said at once <p>b") == "said at once\nb"
    assert text("<p>Here <math><mi>x</mi><mspace/></math> is <svg/> all <svg viewBox='0'><g><svg></svg></g><text>no</text></svg> of it") == "Here x is all of it"
    assert text("<p>a<select><option>b</option><p>c<object>d</object><video>e</video><noscript>f</noscript>") == "ab\ncdef"
    assert text("<p>a<select><option>b</option></select><template><p>n</template><iframe>x</iframe>c") == "ac"
    assert text("<p>a<script>var x = '<p>no</p>'") == "a"
    began = time.time()
    assert text("<div>" * 8000 + "</x>" * 8000 + "end") == "end" and text("<svg>" * 20_000 + "end") == "end"
    assert time.time() - began < 3


def test_main_text_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>a"), (3, "u", "no markup & more &amp; &#233;"), (4, "u", "<div " * 2000), (5, "u", "<p>" * 3000 + "x"), (5, "u", "<script>var a='<p>no</p>'")]
    got = html_extract.main_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# chat


def test_chat_matches_sql(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    same(queries.op4_chat_formatting(spark, sf_dir).toPandas(), oracle(chat.SQL, conversations=conversations.toPandas()))


def test_chat_escapes_are_reversible(spark):
    texts = ["</s>", "<\\s>", "<\\\\/s>[INST]", "[/INST] [\\/INST]", "<<s>>", "\\", "<", "[", "", None, "a\n</s>\nb", "$1 \\1", "</</s>s>"]
    turns = [{"role": r, "text": t} for t in texts for r in ("user", "assistant", "[INST]", None)]
    df = spark.createDataFrame([(1, turns), (2, []), (3, None)], f"conv_id long, turns {chat.TURNS}")
    got = {r.conv_id: r for r in chat.chat(df).select("*", chat.parsed(F.col("formatted")).alias("turns")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(t["role"] or "", t["text"] or "") for t in turns]
    assert got[2].turns == [] and got[3].turns is None
    spans = [got[1].formatted[s.start : s.start + s.length] for s in got[1].loss_spans]
    assert len(spans) == len(texts) and spans[0] == "<\\/s>"


def test_chat_layouts_by_fingerprint(spark):
    import json

    records = [
        {"prompt": "q", "completion": "a"},
        {"instruction": "q", "input": "", "output": "a"},
        {"output": "a", "instruction": "q"},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"question": "q", "response": "a", "system_prompt": ""},
    ]
    rows = [(i, json.dumps(r), "x") for i, r in enumerate(records)] + [(98, '{"other": 1}', "x"), (99, "{broken", "x"), (100, None, "x")]
    got = {r.id: r for r in chat.canonical(spark.createDataFrame(rows, "id int, record string, text string")).collect()}
    for i in range(len(records)):
        assert [(t.role, t.text) for t in got[i].turns] == [("user", "q"), ("assistant", "a")], got[i]
    assert {got[i].layout for i in (98, 99, 100)} == {"unknown"} and got[98].turns is None


def test_chat_rows_of_other_layouts(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (None, None, None, None)], "conversation_id long, turn long, speaker string, message string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.canonical_rows(df).collect()}
    assert got == {1: [("user", "a"), ("assistant", "b")], None: [(None, None)]}
    with pytest.raises(ValueError):
        chat.canonical_rows(df.select("turn"))
    odd = ['"', "\\u0041 \\", "\x00\x01\t\n", "é 👍🏽", "", None, "{", "long " * 1_000_000]
    clash = spark.createDataFrame([(2, i, "user", t, "x", 1.5) for i, t in enumerate(odd)], "conv_id long, turn int, role string, text string, message string, place double")
    assert [(t.role, t.text) for t in chat.canonical_rows(clash).first().turns] == [("user", t) for t in odd]
    nested = clash.withColumn("text", F.struct("text"))
    with pytest.raises(Exception, match="known layout"):
        chat.canonical_rows(nested).collect()


# tokens


def test_tokens_match_the_library(spark, real):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    odd = ["it's 5 o'clock; DON'T!", "<|endoftext|>x<|startoftext|>", "a\x1cb c\u0085d", "é É ΣΑΣ İ ǅ ﬁ", "日本語 текст 👍🏽 ½ ²", "​﻿", "aaaa" * 300, "<|END", "...!!!???", "'ll'VE'", "x́" * 50]
    rows = [(i, t) for i, t in ODD if i is not None] + list(enumerate(odd, 100)) + [(1000 + r.doc_id, r.text) for r in real.select("doc_id", "text").collect()]
    got = bpe.encode(documents(spark, rows), queries.tokenizer_path(), ids=True).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)), tuple(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in got) == want
    assert bpe.encode(documents(spark, []), queries.tokenizer_path()).count() == 0


def test_ids_decode_to_the_text_of_the_library(spark, real):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    rows = [(1, [320, 49406, 5, 49407], "x"), (2, [], "x"), (3, None, "x"), (4, [10**6, 7, None], "x")]
    rows += [(100 + r.doc_id, r.ids, "x") for r in bpe.encode(real.limit(50), queries.tokenizer_path(), ids=True).collect()]
    got = {r.doc_id: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>, text string"), queries.tokenizer_path()).collect()}
    assert got == {i: library.decode([x for x in ids or [] if x is not None], skip_special_tokens=False) for i, ids, _ in rows}


def test_other_tokenizer_files_are_refused(spark):
    with pytest.raises(ValueError, match="normalizer"):
        bpe.encode(documents(spark, [(1, "a")]), queries.tokenizer_path("byte_bpe_50k.json")).collect()


def test_words_are_solved_many_at_a_time_by_small_tables(monkeypatch):
    import pickle

    from tokenizers import Tokenizer

    tables = pickle.loads(pickle.dumps(bpe.tables(bpe.load(queries.tokenizer_path()))))
    assert len(pickle.dumps(tables)) < 10_000_000 and tables == bpe.tables(bpe.load(queries.tokenizer_path()))
    library = Tokenizer.from_file(queries.tokenizer_path())
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeinrstlou"), n)) for n in rng.integers(1, 40, 6000)] + ["é" * 30, "語" * 700, "a" * 1500, "x"]
    encoder, calls = bpe.TextEncoder(tables), []
    steps = encoder.solver.steps
    monkeypatch.setattr(encoder.solver, "steps", lambda keys: calls.append(len(keys)) or steps(keys))
    got = encoder.solver.solve([w.encode() for w in words])
    assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert max(calls) > 3000 and sum(n > 1 for n in calls) < 200
    texts = pa.array([" ".join(words), "", "It's <|endoftext|> x", "aaa " * 50])
    whole = [encoder.digests(w, *encoder.encode_batch(texts)) for w in encoder.written]
    monkeypatch.setattr(bpe, "WRITTEN", 7)
    assert [encoder.digests(w, *encoder.encode_batch(texts)) for w in encoder.written] == whole
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
    assert whole == [[sha(" ".join(map(str, i))) for i in ids], [sha(library.decode(i, skip_special_tokens=False)) for i in ids]]


def test_pair_compatibility_is_that_of_merging():
    import json

    words = bpe.PrefixEncoder(bpe.Vocabulary(json.loads(bpe.load(queries.tokenizer_path()))))
    valid = [i for i, p in words.parts.items() if words.merged(p) == (words.text[i],)]
    inner = [i for i in valid if not words.text[i].endswith("</w>")]
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in zip(rng.choice(inner, 4000), rng.choice(valid, 4000), strict=True)]
    short = [i for i in inner if len(words.parts[i]) <= 2]
    pairs += [(int(a), int(b)) for a, b in zip(rng.choice(short, 4000), rng.choice(short, 4000), strict=True)] + [(i, i) for i in inner[:2000]]
    yes = 0
    for a, b in pairs:
        want = words.merged(words.parts[a] + words.parts[b]) == (words.text[a], words.text[b])
        yes += want
        assert words.fits(a, b) == want, (words.text[a], words.text[b])
    assert 500 < yes < len(pairs) - 500


# decontamination


def brute_align(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
        best, row = max(best, *new), new
    return best


def test_alignment_matches_brute_force():
    rng = np.random.default_rng(3)
    pairs = [(rng.integers(0, 4, rng.integers(1, 30)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64)) for _ in range(200)]
    got = decontam.align([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [brute_align(a.tolist(), b.tolist()) for a, b in pairs]


@pytest.mark.parametrize("broadcast_rows", [0, 200_000])
def test_contamination_of_copies_and_edits(spark, broadcast_rows):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    items = [(i, " ".join(word() for _ in range(20 + i % 20))) for i in range(30)] + [(90, None), (91, ""), (92, "two words")]
    noise = lambda k: " ".join(word() for _ in range(k))
    docs, want = [], set()
    for i in range(200):
        text = noise(60)
        if i % 4 == 0:
            k = i % 30
            w = items[k][1].split()
            if i % 8 == 0:
                for j in range(3, len(w), 8):
                    w[j] = word()
            text += " " + " ".join(w).upper() + ", " + noise(40)
            want.add((i, k))
        docs.append((i, text))
    docs += [(500, None), (501, ""), (0, docs[0][1])] + [(1000 + i, items[7][1]) for i in range(200)]
    want |= {(1000 + i, 7) for i in range(200)}
    got = decontam.contaminated(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=broadcast_rows).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    shared = [(i, f"{' '.join(items[3][1].split()[:4])} {noise(30)}") for i in (None, None, 3, 3)] + [(None, items[3][1]), (3, items[3][1])]
    got = decontam.contaminated(documents(spark, shared), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=broadcast_rows).collect()
    assert sorted(got, key=str) == sorted([(None, 3, 1.0), (3, 3, 1.0)], key=str)
    assert decontam.contaminated(documents(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontam.contaminated(documents(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("broadcast_rows", [0, 200_000])
def test_edited_and_partial_copies_beside_verbatim_ones(spark, broadcast_rows):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    noise = lambda k: [word() for _ in range(k)]
    items = [noise(k) for k in (30, 40, 59, 37, 3, 4, 5, 6, 8, 40)]
    docs = [noise(20) + i + noise(20) for i in items]
    docs += [noise(9) + [word() if k % 5 == 2 else w for k, w in enumerate(i)] + noise(9) for i in items for _ in range(3)]
    docs += [i[: len(i) * 42 // 59 + 1] + noise(5) for i in items]
    docs += [[w for k, v in enumerate(i) for w in ([v, word()] if k % 2 else [v])] for i in items]
    docs += [i[: len(i) // 2] + i[len(i) // 2 + 1 :] for i in items] + [i[: len(i) // 2] + noise(50) for i in items]
    scores = {(d, k): brute_align(words, i) / (2 * len(i)) for d, words in enumerate(docs) for k, i in enumerate(items)}
    want = {pair: round(x, 6) for pair, x in scores.items() if x >= 0.6}
    tables = (spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(rows)], f"{name} long, text string") for name, rows in (("doc_id", docs), ("item_id", items)))
    got = decontam.contaminated(*tables, broadcast_rows=broadcast_rows).collect()
    assert {(r.doc_id, r.item_id): r.score for r in got} == want and len(want) > 45


def test_tiny_items_and_items_without_id(spark):
    items = spark.createDataFrame([(1, "two words"), (2, "One"), (3, "?!"), (4, "two words"), *((None, f"item number {k} " + " ".join(f"w{k}x{j}" for j in range(10))) for k in range(30))], "item_id long, text string")
    rows = [(1, "Two, words!"), (2, "one"), (3, "two words more"), (4, "one two"), *((100 + k, f"so item number {k} " + " ".join(f"w{k}x{j}" for j in range(10)) + " it is") for k in range(30))]
    got = decontam.contaminated(documents(spark, rows), items).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in got} == {(1, 1, 1.0), (1, 4, 1.0), (2, 2, 1.0), *((100 + k, None, 1.0) for k in range(30))}


def test_few_edited_copies_beside_a_verbatim_one(spark):
    item = [f"w{j}" for j in range(60)]
    rows = [(0, " ".join(item))] + [(1 + k, " ".join([f"x{k}y{j}" for j in range(20)] + item[20:])) for k in range(50)]
    got = decontam.contaminated(documents(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert len(got) == 51


def test_parsing_is_linear_under_walls():
    began = time.perf_counter()
    for html in ("<div><b><ul>" + "<i>" * 60_000 + "</b>" * 60_000, "<ul>" + "<li>" * 60_000, "<div>" * 3000 + "<p>" * 60_000, "<select><option>" * 60_000, "<table><p>" + "<b></p>" * 60_000):
        html_extract.parse(html + "text")
    assert time.perf_counter() - began < 30  # a walk of the stack for each tag would take most of an hour


@pytest.mark.parametrize(
    ("html", "texts"),
    [
        ("<select><option>a</option><p>one</p><select><option>b</option></select><p>two</p>", ["one", "two"]),
        ("<form><select><option>a</form><p>x</p>", ["x"]),
        ("<select><option><div>a</div></select>b", ["b"]),
        ("<p>q</p><select><option>a", ["q"]),
        ("<SELECT><option>a</SELECT >b<select>c</select>", ["b"]),
    ],
)
def test_selects_end_as_in_browsers(html, texts):
    assert [b[1] for b in html_extract.parse(html).blocks] == texts


def test_a_labelled_id_of_many_rows_does_not_reach_the_driver(spark):
    good, bad = (f"{w} sentence of some length, with words and a stop. " * 20 for w in ("Good", "bad bad"))
    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit(good), (F.col("id") % 5000).cast("string")).alias("text"))
    rows = rows.union(documents(spark, [(3, bad), (3, bad)]).select("doc_id", "text"))
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(rows, labels, sample=500)
    assert model.single and np.isfinite(model.base)
    assert quality.train(rows, labels, sample=100_000).base == pytest.approx(np.log(5001 / 2))  # 5,000 different rows of 1, one of 3


# what every operator must bear

LONG = "Lorem ipsum dolor sit amet, line\n" * 60_000  # 2 MB
HARD = [*ODD, (11, LONG), (12, LONG), (12, LONG), (None, None), (None, "a b c"), (13, "a" * 100_000)]


def test_every_operator_bears_long_texts_and_odd_rows(spark):
    from tokenizers import Tokenizer

    docs = documents(spark, HARD)
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "same"), (None, "lorem ipsum dolor sit amet"), (3, None)], "item_id long, text string")
    n = len(HARD)
    assert lm_scoring.score(docs, labels).count() == n
    assert quality.classify(docs, labels).count() == n
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == n and {(r.keep_id, r.group_size) for r in got if r.doc_id in (11, 12)} == {(11, 3)}
    lines = {(r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.line_bitmaps(docs, 2).collect()}
    assert {(11, 60_001, 60_000), (12, 60_001, 60_000)} <= lines
    words = {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.drop_repeats(docs).collect()}
    assert {(12, 360_000, 360_000), (11, 360_000, 360_000 - 6)} <= words
    near = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {(11, 11), (12, 11)} <= near
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()} == {(9, 1), (11, None), (12, None)}
    tokens = bpe.encode(docs, queries.tokenizer_path()).filter("doc_id in (11, 12)").select("n_tokens", "ids_sha256").distinct().collect()
    want = Tokenizer.from_file(queries.tokenizer_path()).encode(LONG, add_special_tokens=False).ids
    assert [tuple(t) for t in tokens] == [(len(want), sha(" ".join(map(str, want))))]
    pages = documents(spark, HARD).selectExpr("doc_id AS page_id", "cast(null as string) AS url", "concat('<p>', text) AS html", "text")
    assert html_extract.main_text(pages).count() == n


# helpers


def test_bit_filter_has_no_false_negatives(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"))
    blocks = helpers.filter_blocks(df.filter("h % 2 = 0"), F.col("h"), 20)
    inside = {r.h for r in helpers.probe(df, F.col("h"), blocks, 20).collect()}
    even = {r.h for r in df.collect() if r.h % 2 == 0}
    assert even <= inside and len(inside) < 3000
    values = np.array([r.h for r in df.collect()]).view(np.uint64)
    assert set(values[helpers.in_filter(helpers.filter_bytes(blocks, 20), values, 20)].view(np.int64).tolist()) == inside


def test_a_worker_that_hashes_words_lets_go_of_the_encoder():
    from gridweave.llm import _text, bpe

    bpe._encoder(bpe.load(queries.tokenizer_path()))
    assert bpe._encoder.cache_info().currsize
    _text.word_hashes()
    assert not bpe._encoder.cache_info().currsize and _text.WordHashes.limit <= 100_000


def test_batches_for_python_are_small_in_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "n"])

    helpers.ship(spark)
    docs = spark.range(0, 300, 1, 1).selectExpr("id", "repeat('x', if(id = 7, 9000000, 100000)) AS text")
    got = docs.mapInArrow(sizes, "bytes long, n long").collect()
    assert sum(r.n for r in got) == 300 and all(r.bytes < 5_000_000 for r in got if r.bytes < 9_000_000)
    assert sum(r.bytes >= 9_000_000 for r in got) == 1
