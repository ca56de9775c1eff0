"""Every text operator and stage: nulls, empty and very long texts, repeats, empty tables, clashing column names."""

from __future__ import annotations

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabverity.llm import bpe, common, decontaminate, jaccard, language, lines, neighbours, pieces, pii, quality, substring, tokenfiles

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en"),
    (3, None, None), (4, "", "en"), (5, "   \n\t ", None), (6, "1234 5678 !!", "en"), (7, "x" * 70_000, "en"), (8, "un deux trois " * 6_000, "fr"),
    (9, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en"), (9, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en"),
    (None, "Ein kleiner Hund läuft über die große Straße", "de"), (None, None, None), (10, "мир труд май", None), (11, "a@b.co +1 (803) 555-5351", "en"),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    clash = {c: F.lit("clash") for c in ("n_words", "row_key", "n", "class", "size", "part", "score", "h1", "owner", "kept", "spans", "ids", "label", "n_removed", "source", "bucket")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(clash)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language(spark, docs, empty):
    model = language.train(docs)
    rows = language.identify(docs, model).collect()
    assert len(rows) == len(ROWS)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 for k in (3, 4, 5, 6))
    assert by_id[8]["lang_pred"] == "fr"
    assert by_id[10]["lang_pred"] in model.languages
    assert language.identify(empty, model).count() == 0
    assert language.identify(docs, language.train(empty)).where("lang_pred <> 'und'").count() == 0
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert {3, 4, 5, 6, 10}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_spans_of_mixed_text(spark):
    en, fr = "the house of the thing with that other one", "le chien est dans la maison avec les autres"
    train = spark.createDataFrame([(k, " ".join([t] * 5), lang) for k, (t, lang) in enumerate([(en, "en"), (fr, "fr")] * 3)], SCHEMA)
    model = language.train(train)
    row = language.identify(spark.createDataFrame([(1, f"{en}. {fr}", None)], SCHEMA), model).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "fr"]
    assert (row["spans"][0]["start"], row["spans"][0]["end"], row["spans"][1]["end"]) == (0, len(en), len(en) + 2 + len(fr))


def test_lines(spark, docs, empty):
    out = lines.dedup_lines(docs.drop("n_removed"))
    assert out.count() == len(ROWS)
    assert lines.dedup_lines(empty).count() == 0
    text = "\n".join(f"line {k} of a passage" for k in range(40))
    rows = [(1, text), (2, f"new first line\n{text}"), (3, None), (4, ""), (5, "\n\n\n"), (6, "\n\n\n"), (7, text + "\n" + text)]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == text
    assert got[1]["n_removed"] == 0
    assert got[2]["n_removed"] > 0
    assert got[2]["text"].startswith("new first line")
    assert (got[3]["text"], got[3]["n_lines"]) == (None, 0)
    assert (got[4]["text"], got[4]["n_lines"]) == ("", 1)
    assert got[5]["text"] == got[6]["text"] == "\n\n\n"
    assert got[7]["n_lines"] == 80


def test_jaccard(spark, docs, empty):
    rows = jaccard.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [by_id[k]["component_id"] for k in (1, 2, 9)] == [1, 1, 1]
    assert [by_id[k]["component_id"] for k in (3, 4, 5)] == [3, 4, 5]
    assert [by_id[k]["n_shingles"] for k in (3, 4, 5, 6, 7)] == [0, 0, 0, 1, 1]
    assert jaccard.near_duplicates(empty).count() == 0


def test_substring(spark, docs, empty):
    rows = substring.remove_repeats(docs).collect()
    assert len(rows) == len(ROWS)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert (by_id[1]["n_removed"], by_id[2]["n_removed"], by_id[2]["kept_text"]) == (0, 16, "")
    assert by_id[8]["n_removed"] == 0  # repeats within one document stay
    assert (by_id[3]["n_words"], by_id[3]["kept_text"]) == (0, "")
    assert substring.remove_repeats(empty).count() == 0


def test_decontaminate(spark, docs, empty):
    items = spark.createDataFrame([("b", "brown fox jumps over the lazy dog and runs far away"), ("a", "мир труд"), ("c", None), ("d", ""), (None, "quick brown")], "item_id string, text string")
    found = {r["doc_id"]: r for r in decontaminate.find_contamination(docs, items).collect() if r["doc_id"] is not None}
    assert found[1]["items"] == ["b"]
    assert found[1]["hit_words"] == list(range(2, 13))
    assert found[10]["items"] == ["a"]
    assert found[3]["n_words"] == 0
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert {1, 2, 9, 10}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert kept.count() == len(ROWS) - 5
    assert decontaminate.find_contamination(empty, items).count() == 0
    assert decontaminate.find_contamination(docs, items.limit(0)).where("size(items) > 0").count() == 0


def test_decontaminate_in_blocks_gives_the_same(spark, docs, monkeypatch):
    items = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(["brown fox jumps over the lazy dog and runs far away", "lazy dog", "far away from here", "un deux trois un"])], "item_id string, text string")
    key = lambda df: sorted(map(str, decontaminate.contamination_digest(df).collect()))
    whole = key(decontaminate.find_contamination(docs, items))
    monkeypatch.setattr(decontaminate, "PATTERN_BYTES", 20)
    assert key(decontaminate.find_contamination(docs, items)) == whole


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 12)] + [(None, 1), (99, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r["score"] <= 1 for r in rows)
    constant = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, constant).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def test_tree_rules():
    text = "\n".join(["model", "  If (feature 0 <= 1.5)", "   If (feature 1 <= 2.0)", "    Predict: 0.0", "   Else (feature 1 > 2.0)", "    Predict: 1.0", "  Else (feature 0 > 1.5)", "   Predict: 1.0"])
    a, b = quality.STATISTICS[:2]
    assert quality.tree_rules(text) == [((a, True, 1.5),), ((a, True, 1.5), (b, True, 2.0)), ((a, True, 1.5), (b, False, 2.0)), ((a, False, 1.5),)]


def test_bpe(spark, docs, empty):
    tokenizer = bpe.load_tokenizer(PATH)
    digest = lambda s: __import__("hashlib").sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in ROWS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), digest(" ".join(map(str, ids))), digest(tokenizer.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in bpe.encode_and_decode(docs, PATH).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert bpe.encode_and_decode(empty, PATH).count() == 0


def test_token_files(spark, docs, empty):
    tokenizer = bpe.load_tokenizer(PATH)
    got = sorted(tokenfiles.read_ids(tokenfiles.write_ids(docs, PATH)).collect(), key=lambda r: r["start"])
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for row, (i, text, _) in zip(got, order, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (i, start, len(ids))
        assert list(memoryview(row["ids"]).cast("I")) == ids
        start += len(ids)
    files = tokenfiles.write_ids(empty, PATH)
    assert tokenfiles.read_ids(files, tokenfiles.write_manifest(files)).count() == 0


def test_a_lost_part_of_a_token_file_is_noticed(spark, docs):
    files = tokenfiles.write_ids(docs.repartition(4), PATH)
    manifest = tokenfiles.write_manifest(files)
    assert tokenfiles.read_ids(files, manifest).count() == len(ROWS)
    lost = manifest.agg(F.max("part")).first()[0]
    for rest in (files.where(F.col("part") != lost), files.limit(0)):
        with pytest.raises(tokenfiles.DamagedFile, match="part"):
            tokenfiles.read_ids(rest, manifest)


def test_personal_data(spark, docs, empty):
    rows = pii.find_personal_data(docs).collect()
    assert len(rows) == len(ROWS)
    found = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [(s["kind"], s["start"], s["end"]) for s in found[11]["base"]] == [("email", 0, 6), ("phone", 7, 24)]
    assert found[3]["base"] == []
    assert pii.find_personal_data(empty).count() == 0


def test_patterns_discover_unseen_identifiers(spark):
    valid = ["4539148803436467", "5555555555554444", "4111111111111111", "378282246310005", "6011111111111117"]
    rows = [(k, f"please charge card number {v} for this order") for k, v in enumerate(valid)] + [(50, "please charge card number 4539148803436468 for this order"), (51, "in room 4539148803436468 there is nothing")]
    found = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[50]["base"] == []
    assert [(s["kind"], s["start"], s["end"]) for s in found[50]["spans"]] == [("card", 26, 42)]
    assert found[51]["spans"] == []


def test_patterns_hold_numbers_written_with_spaces(spark):
    spaced = lambda n: " ".join(n[k : k + 4] for k in range(0, len(n), 4))
    cards = [spaced(c) for c in ("4539148803436467", "5555555555554444", "4111111111111111", "378282246310005", "6011111111111117")]
    rows = [(k, f"please charge card number {c} for this order") for k, c in enumerate(cards)] + [(10, "please charge card number 4539 1488 0343 6468 for this order")]
    rows += [(20 + k, f"on day {k} you may call +1 (803) 555-535{k}, or write") for k in range(5)] + [(30, "you may call 1 (803) 555-5359, 12 times")]
    # The words before a mention may be mentions themselves, long, or a single one at the start.
    rows += [(40 + k, f"unit b{k} at +1 (212) 555-010{k} daily") for k in range(5)] + [(50, "unit b7 at 1 (212) 555-0109 daily")]
    rows += [(60 + k, f"{'x' * 30} serial{'y' * 30} {c}") for k, c in enumerate(cards)] + [(70, f"{'x' * 30} serial{'y' * 30} 4539 1488 0343 6469")]
    rows += [(80 + k, f"Iban: {c}") for k, c in enumerate(cards)] + [(90, "Iban: 4539 1488 0343 6461")]
    rows += [(100, "a@b.co 4111 1111 1111 1111, 5555 5555 5555 4444 7 c@d.co")]
    source = spark.createDataFrame(rows, "doc_id long, text string")
    source = source.withColumn("row", F.xxhash64("text"))
    all_ = pii.with_seeds(pii.candidates(source), pii.base_spans(source))
    seen = {r["doc_id"]: r for r in all_.where("doc_id in (0, 20, 40)").collect() if r["seed"]}
    assert [(seen[k]["body"], seen[k]["patterns"][2].split("\x01")[1:3], seen[k]["seed"]) for k in (0, 20, 40)] == [("4539 1488 0343 6467", ["number", "card"], "card"), ("+1 (803) 555-5350", ["call", "may"], "phone"), ("+1 (212) 555-0100", ["at", "b0"], "phone")]
    bodies = {r["body"] for r in pii.candidates(source.where("doc_id = 100")).collect()}
    assert {"a@b.co", "4111 1111 1111 1111", "5555 5555 5555 4444", "c@d.co"} <= bodies
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_personal_data(source).collect()}
    assert found[10] == [("card", 26, 45)]
    assert found[70] == [("card", 68, 87)]
    assert found[90] == [("card", 6, 25)]
    # An unseen phone without its plus sign has another shape than the seeds.
    assert found[30] == [] and found[50] == []


def luhn(prefix: str) -> str:
    total = sum(sum(divmod(int(c) * 2, 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(prefix)))
    return prefix + str(-total % 10)


def test_numbers_that_run_into_each_other_are_found(spark):
    word = lambda k: "abcdefghijklmnopqrst"[k % 20] * (k % 7 + 1)
    cards = [luhn(f"{400000123456780 + 7919 * k}") for k in range(18)]
    rows = [(k, f"{word(k)} {c} {word(k + 3)}") for k, c in enumerate(cards[:16])]
    rows += [(100, f"so {cards[16]} {cards[17]} is"), (101, "so 4012888888881882 5105105105105101 is")]
    rows += [(200 + k, f"{word(k)} +1 (803) 555-53{k:02} {word(k + 5)}") for k in range(12)] + [(300, "so +1 (803) 555-5359 10.20.30.40 is")]
    found = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = lambda k: [(s["kind"], s["start"], s["end"]) for s in found[k]["spans"]]
    assert found[100]["base"] == [] and spans(100) == [("card", 3, 19), ("card", 20, 36)]
    assert spans(101) == []
    assert spans(300) == [("ip", 21, 32), ("phone", 3, 20)]


def test_patterns_discover_spaced_phones(spark):
    rows = [(k, f"for help dial +1 (803) 555-535{k} at noon") for k in range(5)] + [(10, "for help dial +1 (80) 35-3 at noon"), (11, "we were born +1 (80) 35-3 at noon")]
    found = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[10]["base"] == []
    assert [(s["kind"], s["start"], s["end"]) for s in found[10]["spans"]] == [("phone", 14, 26)]
    assert found[11]["spans"] == []


def test_neighbours(spark):
    vectors = [(k, [float(k), 1.0]) for k in range(40)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [3.0, 1.0]), (104, [3.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"node": F.lit(1), "d": F.lit(2), "query": F.lit(3)})
    got = neighbours.nearest(df, df.where("vec_id in (3, 0, 101)"), k=4).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1.0), (0, 2, 2.0), (0, 3, 3.0), (0, 103, 3.0), (3, 103, 0.0), (3, 104, 0.0), (3, 2, 1.0), (3, 4, 1.0)]
    few = neighbours.nearest(df.where("vec_id < 3"), df.where("vec_id = 0"), k=10)
    assert few.count() == 2
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_of_odd_rows(spark):
    """Vectors of another length take no part; a repeated id is one candidate and one query."""
    rows = [(k, [float(k), 1.0]) for k in range(20)] + [(50, [1.0, 2.0, 3.0]), (51, [1.0]), (2, [11.0, 1.0]), (2, [11.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in neighbours.nearest(df, df.where("vec_id in (10, 50)"), k=4).orderBy("query_id", "rank").collect()]
    assert got == [(10, 2, 1.0), (10, 9, 1.0), (10, 11, 1.0), (10, 8, 2.0)]
    twice = neighbours.nearest(df, df.where("vec_id = 2"), k=3).collect()
    assert len(twice) == 3 and 2 not in {r["vec_id"] for r in twice}


def test_neighbours_of_a_vector_alone_in_all_partitions(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 8)) * 0.001
    x[:, 0] += 1
    x[399] = [-1] + [0] * 7  # opposite to all others: alone on its side of every plane
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(399, x[399].tolist()), (1000, [-0.9] + [0.0] * 7)], df.schema)
    got: dict[int, list] = {}
    for r in neighbours.nearest(df, asked).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    d = ((x[:399] - x[399]) ** 2).sum(axis=1)
    assert got[399] == np.argsort(d, kind="stable")[:10].tolist()
    assert got[1000][0] == 399 and len(got[1000]) == 10
    packed = df.select(F.col("vec_id"), F.col("embedding").alias("vector")).mapInArrow(neighbours.pack, "vec_id long, vector binary").select(F.col("vec_id").alias("node"), "vector")
    graph = neighbours.build_graph(neighbours.single(packed, "vector"))
    full = neighbours.DEGREE
    assert {r["count"] for r in graph.where(f"rank <= {full}").groupBy("node").count().collect()} >= {full} and graph.where("node = 399").count() == full
    assert graph.where("other = 399").count() > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_pipeline_stages(spark, docs, empty):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    whole = docs.withColumn("n_chars", F.length("text").cast("long"))
    for table in (whole, empty.withColumns({"source": F.lit("s"), "n_chars": F.lit(0).cast("long")})):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf_dir)
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == table.columns
            out.collect()
    kept = corpus_pipeline.drop_near_duplicates(spark, whole, sf_dir).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 7, 8, 10, 11]


def test_bitmaps_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    cuts = np.arange(0, 5 * 3001, 5)
    found = rng.integers(0, 1 << 63, cuts[-1], dtype=np.uint64)
    tracemalloc.start()
    got = jaccard.bitmaps(found, cuts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 << 20
    places = (found % np.uint64(32 * jaccard.BITMAP_WORDS)).astype(int).reshape(-1, 5)
    counts = [np.bincount(row, minlength=32 * jaccard.BITMAP_WORDS) for row in places]
    assert (got == np.array([np.packbits(np.concatenate([c > 0, c > 1])).view(np.uint64) for c in counts])).all()


def test_a_worker_remembers_for_one_operator():
    batch = pa.RecordBatch.from_pydict({"text": ["a b", None]})
    common.REMEMBERED["encoder"] = object()
    assert [texts for _, texts in common.text_batches([batch], [], remember=True)] == [[b"a b", b""]] and common.REMEMBERED
    assert [texts for _, texts in common.text_batches([batch], [])] == [[b"a b", b""]] and not common.REMEMBERED


def test_long_texts_take_one_python_worker_a_task(spark, docs):
    """A task of two Python steps takes two workers, which stay beside those of later stages."""
    plan = bpe.encode_and_decode(docs, PATH)._jdf.queryExecution().executedPlan().toString()
    # short texts, parts, and the encoding of parts; what merges them makes the digests too
    assert plan.count("FlatMapGroupsInPandas") == 1 and plan.count("MapInArrow") == 3


def test_groups_of_shingles_in_any_batches():
    """Entries are read where the batch has them, at any place, and cut batches give the same groups."""
    words = " ".join(f"word{k}" for k in range(40))
    texts = [words, words + " more", "eight nine ten eleven twelve"]
    filed = pa.RecordBatch.from_pydict({"text": texts})
    frequent = type("Shared", (), {"value": np.zeros(jaccard.COUNTERS, dtype=bool)})
    rows = pa.Table.from_batches(jaccard._file([filed], 3, 5, 75, frequent)).sort_by("bucket").combine_chunks().to_batches()[0]
    whole = pa.Table.from_batches(jaccard._groups([rows])).to_pylist()
    cut = pa.Table.from_batches(jaccard._groups([rows.slice(k, 1) for k in range(rows.num_rows)])).to_pylist()
    assert len(whole) >= 4 and len(whole) == 2 * len({r["token"] for r in whole}) and sorted(map(str, whole)) == sorted(map(str, cut))


def test_order_2_expects_an_entry_of_no_row_at_first():
    """Where it knows nothing nothing has to be left out; blocks of many lengths, beyond a tile of lanes, come back."""
    rng = np.random.default_rng(6)
    chunks = [np.minimum(rng.zipf(1.3, n), 5_000).astype(np.uint32) for n in (1, tokenfiles.BLOCK_IDS * 40 + 17, 3_000)]
    data = tokenfiles.encode_chunks(chunks)
    assert all((a == b).all() for a, b in zip(chunks, tokenfiles.decode_chunks(data)))
    order1, _ = tokenfiles._order1(np.array([1, 2, 1, 2]), np.array([0]), 2)
    model = tokenfiles.Model(2, [tokenfiles.Table(np.array([2, 2]))], [tokenfiles.Rows(2, *order1)], np.zeros(2, dtype=np.int64))
    model.predict(2)
    assert (model.of[model.expected] == -1).all() and (model.packed[model.expected] == 0).all() and not model.have.any() and not model.mass.any()


def test_batches_of_texts_have_the_ids_of_the_library():
    """Plain, odd and mixed texts, alone and together, with a table of pieces that is forgotten now and then."""
    tokenizer, rng = bpe.load_tokenizer(PATH), random.Random(8)
    alphabets = ["abcdefghij", "ab'sd've'llret", "éèüñßABCÿŸ123×÷İŉ", "!!??''s's  \n\t#$", "é 漢字かな<|endoftext|>İΣσς\x00\x1c\x85 ", "the and ion '"]
    texts = ["".join(rng.choice(alphabets[k % 6] if k % 2 else rng.choice(alphabets)) for _ in range(rng.choice([0, 1, 5, 30, 300]))) for k in range(300)]
    texts += ["a" * 17, "a" * 16, "a" * 15 + "é", "thereafter" * 500, "'", "''s", "'re'", "<|", "a<|b c", "\0", "a\0b", "'start", "x'", "Å é", ""]
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    for memory, step in ((pieces.MEMORY, len(texts)), (300, 7), (300, 1)):
        encode, got = pieces.BatchEncoder(bpe.ids_encoder(PATH), 2, memory), []
        assert encode.merges is not None
        for k in range(0, len(texts), step):
            ids, sizes = encode([t.encode() for t in texts[k : k + step]])
            got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
            assert encode.places.count <= max(memory, 1 + sum(sizes))
        assert got == want


def test_carries_reach_words_that_have_left_the_state():
    """The coder against whole numbers: lanes at the upper end of their range carry through words that are all ones."""
    rng = np.random.default_rng(9)
    lanes, whole = 64, 1 << 18
    coder, low, width, moved = tokenfiles.RangeEncoder(lanes), [0] * lanes, [tokenfiles.MASK] * lanes, [0] * lanes
    for t in range(60):
        start = np.where(np.arange(lanes) % 2 == 0, whole - 1 - rng.integers(0, 2, lanes), rng.integers(0, whole, lanes))
        step = coder.range >> 18
        for k in range(lanes):
            low[k], width[k] = low[k] + int(step[k]) * int(start[k]), int(step[k])
            while width[k] <= tokenfiles.LOW:
                low[k], width[k], moved[k] = low[k] << 16, width[k] << 16, moved[k] + 1
        coder.narrow(slice(0, lanes), step, start, np.ones(lanes, dtype=np.int64))
        assert coder.range.tolist() == width
    assert max(int(w.max()) for _, w in coder.log) >= 1 << 16  # some word carries
    for k, data in enumerate(coder.finish()):
        words = np.frombuffer(data, dtype="<u2").tolist()
        assert len(words) == moved[k] + 3 and sum(w << 16 * (len(words) - 1 - i) for i, w in enumerate(words)) == low[k]
