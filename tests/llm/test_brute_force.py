"""Results on a small table against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tabverity.llm import bpe, jaccard, language, lines, neighbours, quality, queries, substring, tokenfiles

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@needs_data
def test_windows(spark, texts):
    first: dict[tuple, int] = {}
    words = {i: t.encode().split() for i, t in sorted(texts.items())}
    for i, w in words.items():
        for s in range(len(w) - 12):
            first.setdefault(tuple(w[s : s + 13]), i)
    got = {r["doc_id"]: r for r in queries.op8_substring_dedup(spark, SF).collect()}
    for i, w in words.items():
        gone = {x for s in range(len(w) - 12) if first[tuple(w[s : s + 13])] < i for x in range(s, s + 13)}
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), len(gone))
        assert got[i]["kept_sha256"] == substring.sha256([x for k, x in enumerate(w) if k not in gone])


def linked(sets: dict) -> dict:
    """Smallest id that links reach, by comparing all sets that share a shingle."""
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j, both in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def shingles(text: str) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


@needs_data
@pytest.mark.parametrize("block", [4096, 3])
def test_links(spark, monkeypatch, texts, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    traversed = []
    whole = jaccard.tree_pairs
    monkeypatch.setattr(jaccard, "tree_pairs", lambda groups, *a, **k: traversed.append(groups.count()) or whole(groups, *a, **k))
    rng = random.Random(3)
    more = dict(texts)
    for k in range(60):  # near copies on both sides of the threshold
        words = rng.choice(list(texts.values())).split()[:200]
        for _ in range(rng.randint(0, max(1, len(words) // 25))):
            if words:
                words[rng.randrange(len(words))] = f"w{rng.random()}"
        more[100_000 + k] = " ".join(words)
    sets = {i: shingles(t) for i, t in more.items()}
    roots = linked(sets)
    df = spark.createDataFrame(list(more.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()}
    assert got == {i: (len(s), roots[i]) for i, s in sets.items()}
    assert all(n > 0 for n in traversed) and len(traversed) == 2


@pytest.mark.parametrize("block", [4096, 7, 1])
def test_signature_trees_lose_no_link(spark, block):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(30, 60)], rng.integers(0, 1 << 63, rng.integers(1, 25), dtype=np.uint64)])) for _ in range(150)]
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    bits = jaccard.bitmaps(np.concatenate(sets), cuts)
    component = [int(c) for c in rng.integers(0, 40, 150)]
    rows = [(t, k, component[k], len(sets[k]), 0, bits[k].tobytes()) for t in range(90) for k in range(150) if k % 3 != t % 3]
    groups = spark.createDataFrame(rows, "token long, class long, component long, n long, place int, bitmap binary")
    got = {(r["a"], r["b"]) for r in jaccard.tree_pairs(groups, block=block).collect()}
    met = lambda a, b: sum(a % 3 != t % 3 and b % 3 != t % 3 for t in range(90))
    linked = set()
    for a in range(150):
        for b in range(a + 1, 150):
            both = len(np.intersect1d(sets[a], sets[b]))
            if component[a] != component[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and met(a, b) > min(len(sets[a]), len(sets[b])) // 64:
                linked.add((a, b))
    assert linked and linked <= got
    assert len(got) < 150 * 149 / 4
    near = {(r["a"], r["b"]) for r in jaccard.tree_pairs(groups, block=block, nearest=True).collect()}
    assert near <= got and near


def benchmark_patterns(spark) -> dict:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    patterns: dict[tuple, set] = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall((r["text"] or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            patterns.setdefault(tuple(w[k : k + n]), set()).add(str(r["item_id"]))
    return patterns


@needs_data
def test_pipeline(spark):
    """All stages in a row: language by the operator, the rest by SQL, brute force and the library."""
    tokenizers = pytest.importorskip("public_tokenizers")
    tokenizer = bpe.load_tokenizer(tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.identify_language(spark, docs, SF).select("doc_id", "text").toPandas()
    con = duckdb.connect()
    con.register("kept", kept)
    cut = dict(con.sql(f"SELECT doc_id, text FROM ({lines.dedup_sql('kept')})").fetchall())
    roots = linked({i: shingles(t) for i, t in sorted(cut.items())})
    patterns = benchmark_patterns(spark)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def clean(text: str) -> bool:
        w = word.findall(text.translate(LOWER))
        return not any(tuple(w[k : k + n]) in patterns for n in {len(p) for p in patterns} for k in range(len(w) - n + 1))

    left = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in cut.items() if roots[i] == i and clean(t)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {i: (len(x), sha(" ".join(map(str, x)))) for i, x in left.items()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert 0 < len(want) < len(kept) and got == want


@needs_data
def test_base_spans_and_digests(spark, texts):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind: str, m: str) -> bool:
        digits = [int(c) for c in m if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    rows = {r["doc_id"]: r for r in queries.op9_pii(spark, SF).collect()}
    for i, t in texts.items():
        found = [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, t) if valid(k, m[0])]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert [rows[i][f"n_{k}"] for k in kinds] == [sum(f[0] == k for f in found) for k in kinds]
        assert rows[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(rows[i]["spans"].split(","))


@needs_data
def test_scores_are_those_of_the_rules(spark, texts):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    values = quality.statistics([t.encode() for t in texts.values()])
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for i, row in zip(texts, values):
        v = dict(zip(quality.STATISTICS, row))
        total = model.intercept + sum(w for bounds, w in model.rules if all((v[n] <= t) if upper else (v[n] > t) for n, upper, t in bounds))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


@needs_data
def test_benchmark_windows(spark, texts):
    word, patterns = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), benchmark_patterns(spark)
    got = {r["doc_id"]: r for r in queries.op7_decontamination(spark, SF).collect()}
    for i, t in texts.items():
        w = word.findall(t.translate(LOWER))
        hit, items = set(), set()
        for n in {len(p) for p in patterns}:
            for k in range(len(w) - n + 1):
                if found := patterns.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"]) == (len(w), len(hit), len(items))
        assert got[i]["items_sha256"] == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


@needs_data
def test_languages_match_a_plain_search(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    for i, t in [*texts.items()][:60]:
        letters = language.Letters([t.encode()])
        scores, told = language.word_scores(letters, model)
        best = [(v, [k]) for k, v in enumerate(scores[0])] if len(scores) else []
        for row in scores[1:]:
            best = [max(((v - language.SWITCH_PENALTY * (k != p[-1]) + row[k], [*p, k]) for v, p in best), key=lambda x: x[0]) for k in range(len(row))]
        weight = np.zeros(len(model.languages))
        for k, n, s in zip(max(best, key=lambda x: x[0])[1] if best else [], letters.length, told):
            weight[k] += n * s
        if weight.sum():
            assert got[i]["score"] == pytest.approx(weight.max() / weight.sum(), abs=0.02)
            assert got[i]["lang_pred"] == model.languages[weight.argmax()]
            assert sum(s["end"] - s["start"] for s in got[i]["spans"]) <= len(t)
        else:
            assert got[i]["lang_pred"] in ("und", model.languages[model.usual])


@needs_data
def test_held_out_accuracy(spark):
    rows = queries.op1_language_id(spark, SF.replace("0.001", "0.01")).join(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    rows = queries.op4_quality_classifier(spark, SF.replace("0.001", "0.01")).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


@needs_data
def test_recall(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in vectors.collect() if r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    got: dict[int, dict] = {}
    for r in neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        best = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        assert all(got[q][i] == d[ids == i][0] for i in got[q])
        hits += len(set(best) & set(got[q]))
        total += len(best)
    assert hits / total >= 0.9


@pytest.mark.parametrize("shape", ["gaussian", "clusters"])
def test_recall_of_many_vectors(spark, shape):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((20_000, 64)) if shape == "gaussian" else rng.standard_normal((200, 64))[rng.integers(0, 200, 20_000)] + 0.2 * rng.standard_normal((20_000, 64))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": [v.tolist() for v in x]}))
    got: dict[int, set] = {}
    for r in neighbours.nearest(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, len(x), 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argpartition(d, 10)[:10].tolist()))
    assert hits / 2000 >= 0.9


@needs_data
def test_token_queries_match_the_library(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    tokenizer = bpe.load_tokenizer(tokenizers.path("word_bpe_49k.json"))
    sf = SF.replace("0.001", "0.01")
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert sum(len(t or "") > bpe.PART_CHARS for _, t in docs) > 3  # texts that are encoded by the tree
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in docs}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {i: (len(x), sha(" ".join(map(str, x))), sha(tokenizer.decode(x, skip_special_tokens=False))) for i, x in ids.items()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op5_bpe(spark, sf).collect()} == want
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op6_token_output(spark, sf).collect()}
    start = 0
    for i, _ in docs:
        raw = np.array([*ids[i], 2], dtype="<u4")
        assert got[i] == (start, len(raw), zlib.crc32(raw.tobytes()))
        start += len(raw)


def test_trees_of_halves():
    tokenizers = pytest.importorskip("public_tokenizers")
    tokenizer = bpe.load_tokenizer(tokenizers.path("word_bpe_49k.json"))
    encode = lambda s: bpe.encode_tokens(tokenizer, s)
    runs = bpe.TextEncoder(tokenizer, lambda ids: np.asarray(ids, dtype="<u4").tobytes())
    rng = random.Random(5)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ab'sd've'llre", "éèüñßABC123", "!!??''s's  \n\t#$", "é 漢字かな<|endoftext|>İΣσς"]
    for k in range(200):
        text = "".join(rng.choice(alphabets[0] if k % 3 == 0 else rng.choice(alphabets)) for _ in range(rng.randint(0, 500)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert bpe.encode_tree(text, encode, 40, 8)[0] == want
        cuts = [0, *bpe.cut_points(len(text), 50), len(text)]
        level = [bpe.encode_part(text[a:b], runs, encode) for a, b in zip(cuts, cuts[1:])]
        while len(level) > 1:
            level = [bpe.merge_parts(*level[i : i + 2], encode) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        assert np.frombuffer(bpe.finish(level[0]), dtype="<u4").tolist() == want


def test_coder_round_trips():
    rng = np.random.default_rng(1)
    chunks = [np.array([2]), np.zeros(9000), rng.integers(0, 49_407, 20_000), np.minimum(rng.zipf(1.3, 50_000), 40_000), np.tile(rng.integers(0, 3000, 500), 30), np.zeros(0)]
    chunks = [c.astype(np.uint32) for c in chunks]
    coded = tokenfiles.encode_chunks(chunks)
    assert all(np.array_equal(a, b) for a, b in zip(chunks, tokenfiles.decode_chunks(coded), strict=True))
    damaged = bytearray(coded[3])
    damaged[-40] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        tokenfiles.decode_chunks([bytes(damaged)])


@needs_data
def test_contexts_predict():
    """Coded ids of whole documents are well under the order-0 entropy, table included."""
    tokenizers = pytest.importorskip("public_tokenizers")
    encode = bpe.ids_encoder(tokenizers.path("word_bpe_49k.json"))
    texts = duckdb.sql(f"SELECT coalesce(text, '') FROM '{SF.replace("0.001", "0.01")}/documents.parquet' ORDER BY doc_id").fetchall()
    ids = np.frombuffer(b"".join(b"".join(encode(t.encode())) for (t,) in texts), dtype="<u4")
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert len(tokenfiles.encode_chunks([ids])[0]) * 8 / len(ids) < 0.87 * -(share * np.log2(share)).sum()


def test_best_paths_match_a_plain_search():
    rng = np.random.default_rng(2)
    counts = [0, 1, 7, 30]
    first = np.concatenate([[0], np.cumsum(counts)])
    scores = rng.normal(size=(first[-1], 3)) * 3
    labels = language.viterbi(scores, first, 2.0)
    for a, b in zip(first, first[1:]):
        value = lambda path, a=a: sum(scores[a + t, s] for t, s in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:]))
        best = {s: (scores[a, s], [s]) for s in range(3)} if b > a else {}
        for t in range(a + 1, b):
            best = {s: max((v - 2.0 * (s != p) + scores[t, s], [*path, s]) for p, (v, path) in best.items()) for s in range(3)}
        if best:
            assert value(labels[a:b].tolist()) == pytest.approx(max(v for v, _ in best.values()))
