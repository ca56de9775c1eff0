"""Hard negatives, SimHash and the audit of sources: brute force, and the edges that their docstrings define."""

from __future__ import annotations

import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tabverity.llm import audit, negatives, queries, simhash

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
LOWER = {i: i + 32 for i in range(65, 91)}


# hard negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def mined(rows, anchor, positives=5, wanted=3, low=50, high=95, scale=256):
    whole = {i: (label, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v, label in rows}
    out = []
    for a in sorted(whole):
        if not anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(whole[a][1], v)) for i, (_, v) in whole.items() if i != a and len(v) == len(whole[a][1])}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if whole[i][0] == whole[a][0]][:positives]:
            fit = [n for n in order if whole[n][0] != whole[a][0] and low * score[p] <= 100 * score[n] <= high * score[p]]
            out += [(a, p, rank + 1, n, score[p], score[n]) for rank, n in enumerate(fit[:wanted])]
    return sorted(out)


def vectors(n, dim, seed, spread=0.3, labels=3):
    rng = np.random.default_rng(seed)
    return [(int(i), rng.normal(scale=spread, size=dim).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("dim", "spread", "labels"), [(7, 0.3, 3), (64, 0.1, 10), (3, 40.0, 2), (16, 0.002, 4), (1, 0.5, 1)])
def test_negatives(spark, monkeypatch, dim, spread, labels):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 90)
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 20)
    rows = vectors(400, dim, dim, spread, labels)
    df = spark.createDataFrame(rows, VECTORS)
    assert got(negatives.hard_negatives(df, F.col("vec_id") % 9 == 0)) == mined(rows, lambda i: i % 9 == 0)


def test_negatives_of_ties_repeats_and_unfit_rows(spark):
    rows = [(i, [0.5, 0.25], i % 2) for i in range(12)] + [(20, [0.25, 0.25], 0), (21, [0.3, 0.2], 1), (22, [1.0], 0), (23, [0.5], 1), (24, [], 0), (25, [], 1)]
    unfit = [(30, None, 0), (31, [0.5, None], 0), (32, [0.5, float("nan")], 1), (33, [float("inf"), 0.0], 1), (34, [0.5, 0.5], None), (None, [9.0, 9.0], 0)]
    again = [(3, [0.5, 0.25], 1), (3, [0.9, 0.9], 1)]  # the least of a repeated id counts
    df = spark.createDataFrame(rows + unfit + again, VECTORS).withColumns({"rank": F.lit("x"), "score": F.lit(1), "block": F.lit(2)})
    assert got(negatives.hard_negatives(df, F.col("vec_id") % 2 == 0)) == mined(rows, lambda i: i % 2 == 0)
    assert not got(negatives.hard_negatives(df.limit(0), F.lit(True)))
    assert not got(negatives.hard_negatives(df, F.lit(False)))
    assert not got(negatives.hard_negatives(df, F.lit(None).cast("boolean")))


def test_negatives_drop_candidates_early():
    rng = np.random.default_rng(1)
    values = rng.integers(-120, 121, size=(2000, 64))
    planes, packed = negatives.slice_bits(values)
    block = negatives.Block(np.arange(2000), np.zeros(2000, dtype=np.int64), planes, packed, 64)
    assert planes == 8 and all((block.bits(k, slice(None), np.int64) == (values >> k) & 1).all() for k in range(planes))
    scores = values @ values[0]
    low, high = scores - 5.0, scores + 5.0
    kept = negatives.possible(low, high, np.array([[-np.inf, 9000.0]]), 3)
    best = np.argsort(-np.where(scores <= 9000, scores, -(10**9)), kind="stable")[:3]
    assert kept[best].all() and kept.sum() < 100


def test_negatives_too_large():
    with pytest.raises(ValueError, match="too large"):
        negatives.product_type(np.full((1, 8), 2**40), 20)


# SimHash

def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    found = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhashed(rows, budget=2):
    bits = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= budget:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((d, f"{bits[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def in_order(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def near_texts(n, seed):
    rng = random.Random(seed)
    bases = [[rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.choice([4, 30, 200]))] for _ in range(8)]
    out = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice("xyz")
        out.append((i * 3 % n + 5, " ".join(words)))
    return out


@pytest.mark.parametrize("leaf", [4096, 7])
def test_simhash(spark, leaf):
    rows = [(i, t) for i, (_, t) in enumerate(near_texts(160, 2))]
    rows += [(300, None), (301, ""), (302, " \n\x0b"), (303, "One"), (304, "one"), (305, "É è one"), (306, "x" * 300_000), (None, "One"), (None, "nobody else says this"), (3, rows[3][1]), (3, "another text of id three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"bits": F.lit(1), "component": F.lit(2), "node": F.lit("x")})
    assert in_order(simhash.near_duplicates(df, leaf=leaf)) == simhashed(rows)
    assert in_order(simhash.near_duplicates(df.limit(0), leaf=leaf)) == []


def test_simhash_trie(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    found = centres[rng.integers(0, 6, 900)]
    for _ in range(3):
        found = found ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    found = np.unique(np.concatenate([found, rng.integers(0, 2**64, 300, dtype=np.uint64), np.array([0, 1, 2**64 - 1], dtype=np.uint64)]))
    near = np.triu(np.bitwise_count(found[:, None] ^ found[None, :]) <= 2, 1)
    want = {(found[i], found[j]) for i, j in zip(*np.nonzero(near))}
    assert {p for a, b in simhash.trie_links(found, None, 2) for p in zip(a, b)} == want
    half = found[::2], found[1::2]
    crossed = {(x, y) for a, b in simhash.trie_links(*half, 2) for x, y in zip(a, b)}
    assert crossed == {(x, y) for x in half[0] for y in half[1] if int(x ^ y).bit_count() <= 2}
    # pairs of leaves hold every link, each once, at whatever depth they end
    df = spark.createDataFrame([(int(x),) for x in found.view(np.int64)], "bits long")
    for leaf in (5, 100):
        pairs = [r for table in simhash.leaf_pairs(df, leaf=leaf) for r in table.collect()]
        times = Counter()
        for r in pairs:
            xs, ys = (np.sort(np.array(v, dtype=np.int64).view(np.uint64)) for v in (r["xs"], r["ys"]))
            for a, b in simhash.trie_links(xs, None if r["x"] == r["y"] else ys, 2):
                times.update(frozenset(p) for p in zip(a.tolist(), b.tolist()))
        assert times == Counter(frozenset((int(a), int(b))) for a, b in want)


def test_simhash_of_pieces(monkeypatch):
    text = " ".join(f"Wort{k % 37} \t\x0c" + "y" * (k % 11) for k in range(400))
    want = plain_fingerprint(text)
    for size in (1, 7, 64, 1 << 18):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert simhash.fingerprint(text.encode()) == want
        assert simhash.fingerprint(b"one two") == plain_fingerprint("one two")


@needs_data
def test_simhash_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert in_order(queries.op12_simhash(spark, SF)) == simhashed(rows)


# audit of sources

def audited(rows, least_docs=3, ranks=200):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        docs = Counter(t for _, _, w in own for t in set(w))
        kept = sorted((t for t, n in docs.items() if n >= least_docs), key=str.encode)
        count = {s: Counter(t for _, x, w in own if x == s for t in w) for s in {r[1] for r in own}}
        whole = sum(count.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        of, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in of:
            pairs = sorted(((-sum(f(of[s][t], of[o][t]) for t in kept), o.encode()) for o in of if o != s))
            terms = sorted(((-f(of[s][t], q[t]), t.encode()) for t in kept if count[s][t] and of[s][t] > q[t]))[:ranks]
            out += [(lang, s, part, x.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, x) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block", [32, 2])
def test_audit(spark, monkeypatch, block):
    monkeypatch.setattr(audit, "BLOCK_SOURCES", block)
    rng = random.Random(5)
    words = ["alpha", "Beta", "É", "é", "zz", "_", "x9y", "ｗｉｄｅ", "\U0001f600", "ß"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "É", None, "￿", "\U00010000"])) for _ in range(120)]
    rows += [("lonely words", "xx", "only"), ("nothing kept", "yy", "a"), (None, "yy", "b"), ("", "yy", None), ("q" * 5000 + " " + "alpha", "en", "empty"), *rows[:5]]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"part": F.lit(1), "item": F.lit(2), "v": F.lit(3), "block": F.lit(4), "rank": F.lit(5)})
    assert got(audit.audit_sources(df)) == audited(rows)
    assert got(audit.audit_sources(df, ranks=2)) == audited(rows, ranks=2)
    assert got(audit.audit_sources(df.limit(0))) == []


@pytest.mark.parametrize("limits", [{}, {"CHUNK_TERMS": 3}, {"CHUNK_ROWS": 4}, {"CHUNK_BYTES": 9}, {"CHUNK_TERMS": 1, "CHUNK_ROWS": 1}])
def test_audit_chunks(monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(audit, name, value)
    rng = random.Random(8)
    rows = sorted({(lang, f"t{rng.randrange(30):02d}".encode() * rng.randint(1, 2), s) for lang in "ab" for s in "xyz" for _ in range(25)})
    rows = [(*r, rng.randint(1, 9), rng.randint(1, 3)) for r in rows]
    names = ("lang", "term", "source", "n", "docs", "part")
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, (*r, 6))) for r in rows[k : k + 7]], schema=pa.schema([("lang", pa.string()), ("term", pa.binary()), ("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64()), ("part", pa.int64())])) for k in range(0, len(rows), 7)]
    chunks = [r for b in audit._chunks(batches, 3) for r in b.to_pylist()]
    docs = Counter()
    for lang, term, _, _, d in rows:
        docs[lang, term] += d
    kept = sorted(k for k, d in docs.items() if d >= 3)
    heads = [r for r in chunks if r["source"] is None]
    assert [(r["lang"], t) for r in sorted(heads, key=lambda r: r["chunk"]) for t in r["words"]] == kept
    words, found = {r["chunk"]: r["words"] for r in heads}, Counter()
    for r in chunks:
        counts = np.frombuffer(r["counts"], dtype=np.int64).tolist()
        ids = np.frombuffer(r["ids"], dtype=np.int32).tolist() if r["source"] else range(r["terms"])
        assert r["n"] == sum(counts) and r["terms"] == len(words[r["chunk"]])
        found.update({(r["lang"], words[r["chunk"]][i], r["source"]): c for i, c in zip(ids, counts)})
    want = Counter({(lang, t, s): n for lang, t, s, n, _ in rows if (lang, t) in set(kept)})
    for (lang, t, _), n in list(want.items()):
        want[lang, t, None] += n
    assert found == want


def test_audit_terms_of_pieces(monkeypatch):
    text = "Ab cÉ9" * 50
    for size in (1, 3, 1000):
        monkeypatch.setattr(audit, "PIECE", size)
        assert [t for piece in audit._terms(text.encode()) for t in piece] == re.findall(rb"[A-Za-z\x80-\xff]+", text.encode().lower())


def test_audit_in_whole_numbers():
    counts = np.array([0, 1, 7, 10**12, 4 * 10**14], dtype=np.int64)
    for total, terms in ((5 * 10**14, 10**8), (4 * 10**14 + 3, 1), (10**15, 7)):
        assert audit.probabilities(counts, total, terms).tolist() == [1 + 10**9 * (int(c) + 1) // (total + terms) for c in counts]
    p, q = np.array([10**9 + 1, 3]), np.array([1, 10**9])
    assert audit.gaps(p, q).tolist() == [10**18, (10**9 - 3) ** 2 // 10**9]
