"""Audit of how much the sources of a language diverge, over integer-coded terms.

1. Tasks count terms by language and source, and in how many documents each occurs; Spark adds these counts up.
2. Counts are dealt by ranges of (language, term), so that all counts of a term meet and terms are in order. A task cuts
   its range into chunks. A chunk's kept terms are a sorted array; counts get their ids by ``searchsorted`` in it, and
   ``bincount`` of the ids gives a vector of each source. Ids follow the UTF-8 order of the terms, chunks too, so that ties
   are decided by (chunk, id).
3. Every chunk meets all sources of its language, blocks of sources in pairs: vectors become dense rows of smoothed
   probabilities, also of sources without any term there, and give partial sums for each pair of sources and the best
   terms of each source. Partial sums are added up, and terms ranked, by Spark.

All arithmetic is in whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, text_batches

#: A term: letters A-Z, a-z and everything beyond ASCII, in bytes of UTF-8.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Documents of a language that a kept term occurs in at least; ranks of terms; unit of probabilities.
LEAST_DOCS, RANKS, UNIT = 3, 200, 1_000_000_000
#: Entries that a task counts before it passes them on, and bytes of a text that are cut into terms at once.
HELD, PIECE = 1 << 18, 1 << 20
#: Rows of counts in a range; terms, bytes of terms and rows of counts in a chunk; sources of a block.
RANGE_ROWS, CHUNK_TERMS, CHUNK_BYTES, CHUNK_ROWS, BLOCK_SOURCES = 1 << 20, 1 << 15, 1 << 21, 1 << 16, 32
#: Copies of a language's sources, so that chunks of one language don't meet them in one task.
SALTS = 32


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a lower-cased text, piece by piece; a term is never cut."""
    text, at = text.lower(), 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and TERM.match(text, end, end + 1):
            end += 1
        yield TERM.findall(text, at, min(end, len(text)))
        at = end


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, docs) of a task's texts; a row without a term for each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [None, *n]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(terms)), "source": pa.array([source] * len(terms)), "term": pa.array(terms, pa.binary()),
                "n": pa.array([0, *n.values()], pa.int64()), "docs": pa.array([0, *(docs[t] for t in n)], pa.int64()),
            })
        held.clear()

    for (langs, sources), texts in text_batches(batches, ["lang", "source"]):
        for lang, source, text in zip(langs, sources, texts):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            once: set[bytes] = set()
            for terms in _terms(text):
                n.update(terms)
                once.update(terms)
            docs.update(once)
        if sum(len(n) + 1 for n, _ in held.values()) > HELD:
            yield from flushed()
    yield from flushed()


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.append(0, np.flatnonzero(new) + 1)


CHUNKS = "lang string, chunk long, source string, n long, terms int, ids binary, counts binary, words array<binary>"


def _chunks(batches: Iterable[pa.RecordBatch], least_docs: int) -> Iterator[pa.RecordBatch]:
    """A row for each source that has terms in a chunk, and one without a source for the whole language.

    Rows come in order of (lang, term); ``part`` numbers the ranges. ``words`` are the chunk's terms, of the row of the
    language alone, whose counts are those of all ids.
    """
    schema = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("source", pa.string()), ("n", pa.int64()), ("terms", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("words", pa.list_(pa.binary()))])
    held: list[pa.Table] = []
    made = 0

    def chunk(table: pa.Table) -> pa.RecordBatch | None:
        """Of rows of one language."""
        terms = np.array(table.column("term").to_pylist(), dtype=object)
        n, docs = table.column("n").to_numpy(), table.column("docs").to_numpy()
        first = _starts(terms)
        kept = terms[first[np.add.reduceat(docs, first) >= least_docs]]
        if not len(kept):
            return None
        ids = np.searchsorted(kept, terms)
        known = kept[np.minimum(ids, len(kept) - 1)] == terms
        ids, n, sources = ids[known], n[known], table.column("source").combine_chunks().dictionary_encode()
        names, group = sources.dictionary.to_pylist(), sources.indices.to_numpy()[known]
        lang, number, rows = table.column("lang")[0].as_py(), (table.column("part")[0].as_py() << 32) + made, []
        whole = np.bincount(ids, weights=n, minlength=len(kept)) if n.sum() < 2**53 else _exact_sums(ids, n, len(kept))
        rows.append({"source": None, "n": int(n.sum()), "ids": b"", "counts": whole.astype(np.int64).tobytes(), "words": list(kept)})
        for g in np.unique(group).tolist():
            own = group == g
            rows.append({"source": names[g], "n": int(n[own].sum()), "ids": ids[own].astype(np.int32).tobytes(), "counts": n[own].astype(np.int64).tobytes(), "words": None})
        return pa.RecordBatch.from_pylist([r | {"lang": lang, "chunk": number, "terms": len(kept)} for r in rows], schema=schema)

    def cut(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        """Chunks of the rows held, but for what may go on in the next batch."""
        nonlocal held, made
        term = table.column("term").combine_chunks()
        lang = table.column("lang").combine_chunks().dictionary_encode().indices.to_numpy()
        codes = term.dictionary_encode().indices.to_numpy()
        first = _starts(lang, codes)
        size = np.add.accumulate(pc.binary_length(term).to_numpy()[first].astype(np.int64))
        number = np.maximum.reduce([np.arange(len(first)) // CHUNK_TERMS, size // CHUNK_BYTES, first // CHUNK_ROWS])
        at = first[_starts(lang[first], number)]
        ends = np.append(at[1:], table.num_rows)
        whole = len(at) if last else max(len(at) - 1, 0)
        for a, b in zip(at[:whole].tolist(), ends[:whole].tolist()):
            found = chunk(table.slice(a, b - a))
            if found is not None:
                made += 1
                yield found
        held = [table.slice(int(at[whole]))] if whole < len(at) else []

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) > 2 * CHUNK_ROWS:
                yield from cut(pa.concat_tables(held), False)
    if held:
        yield from cut(pa.concat_tables(held), True)


def _exact_sums(ids: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(size, dtype=np.int64)
    np.add.at(total, ids, n)
    return total


def probabilities(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / (total + terms)), without a product that exceeds 64 bits."""
    bottom, rest = np.int64(total + terms), counts.astype(np.int64) + 1
    whole = rest // bottom
    rest = rest - whole * bottom
    for _ in range(3):  # UNIT is 1000 ** 3
        rest = rest * 1000
        digit = rest // bottom
        rest = rest - digit * bottom
        whole = whole * 1000 + digit
    return 1 + whole


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


TILES = "lang string, source string, part string, item string, value long, chunk long, id int"
TILES_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("chunk", pa.int64()), ("id", pa.int32())])


def _tile(table: pa.Table, ranks: int) -> pa.Table:
    """Partial sums of two blocks of sources over a chunk; of a block with itself also its sources' best terms."""
    rows = table.to_pylist()
    whole = next((r for r in rows if r["source"] is None), None)
    rows = sorted((r for r in rows if r["source"] is not None), key=lambda r: (r["block"], r["source"]))
    lang, number, terms, v = rows[0]["lang"], rows[0]["chunk"], rows[0]["terms"], rows[0]["v"]
    x, y = rows[0]["x"], rows[0]["y"]
    p = np.empty((len(rows), terms), dtype=np.int64)
    for k, r in enumerate(rows):
        counts = np.zeros(terms, dtype=np.int64)
        if r["ids"]:
            counts[np.frombuffer(r["ids"], dtype=np.int32)] = np.frombuffer(r["counts"], dtype=np.int64)
        p[k] = probabilities(counts, r["total"], v)
    left, right = ([k for k, r in enumerate(rows) if r["block"] == b] for b in (x, y))
    out: list[tuple] = []
    ways = [(i, j) for i in left for j in right if i != j]
    for i, j in ways if x == y else ways + [(j, i) for i, j in ways]:
        out.append((lang, rows[i]["source"], "pair", rows[j]["source"], int(gaps(p[i], p[j]).sum()), None, None))
    if x == y and whole is not None:
        q = probabilities(np.frombuffer(whole["counts"], dtype=np.int64), whole["total"], v)
        for k, r in enumerate(rows):
            ids = np.frombuffer(r["ids"] or b"", dtype=np.int32)
            ids = np.sort(ids[p[k, ids] > q[ids]])
            value = gaps(p[k, ids], q[ids])
            best = np.argsort(-value, kind="stable")[:ranks]
            out += [(lang, r["source"], "term", whole["words"][i].decode(), s, number, i) for i, s in zip(ids[best].tolist(), value[best].tolist())]
    return pa.Table.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), TILES_ARROW)], schema=TILES_ARROW) if out else TILES_ARROW.empty_table()


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every occurring (lang, source).

    Part ``pair``: each other source of the language, with the divergence of this source's terms from its terms. Part
    ``term``: the ``ranks`` terms that stand out most in the source against the language. Ranks are by value, highest first,
    then by the item's UTF-8 bytes.

    A null text, language or source reads as empty. Groups without kept terms have pairs too (all values 0 if the language
    keeps no terms); a language of one source has no pairs. Every row counts, repeated ones too. An empty table gives no
    rows. Only the three columns are read, so other columns don't matter.
    """
    spark = docs.sparkSession
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    counted = source.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    counts = materialize(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    rows = counts.where("term is not null")
    parts = max(shuffle_partitions(spark), -(-rows.count() // RANGE_ROWS))
    dealt = rows.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term").withColumn("part", F.spark_partition_id().cast("long"))
    chunks = materialize(dealt.mapInArrow(lambda it: _chunks(it, least_docs), CHUNKS), "term-chunks")

    sums = chunks.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = chunks.where("source is null").groupBy("lang").agg(F.sum("terms").alias("v"))
    groups = counts.select("lang", "source").distinct().join(sums.where("source is not null"), ["lang", "source"], "left")
    groups = materialize(groups.join(of_lang, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")), "term-groups")
    most = groups.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(1, -(-most // BLOCK_SOURCES))
    groups = groups.withColumn("block", F.pmod(F.xxhash64("source"), F.lit(blocks)))

    # every chunk with all sources of its language
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS))
    heads = chunks.where("source is null").select("lang", "chunk", "terms", salt("chunk").alias("salt"))
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    vectors = chunks.where("source is not null").select("lang", "chunk", "source", "ids", "counts")
    dense = heads.join(salted, ["lang", "salt"]).drop("salt").join(vectors, ["lang", "chunk", "source"], "left")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    tiled = dense.withColumn("other", other).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("other")
    tiled = tiled.withColumn("words", F.lit(None).cast("array<binary>"))
    filled = groups.select("lang", "block").distinct()
    langs = sums.where("source is null").select("lang", "total").join(of_lang, "lang").join(filled, "lang")
    langs = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    wholes = chunks.where("source is null").drop("n", "source", "ids").withColumn("salt", salt("chunk")).join(langs, ["lang", "salt"]).drop("salt")
    wholes = wholes.withColumns({"source": F.lit(None).cast("string"), "ids": F.lit(None).cast("binary"), "x": F.col("block"), "y": F.col("block")})
    met = tiled.unionByName(wholes).groupBy("lang", "chunk", "x", "y").applyInArrow(lambda t: _tile(t, ranks), TILES)
    found = materialize(met, "term-tiles")

    sums_of_pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # pairs of languages that keep no terms have no chunk
    none = groups.where("v = 0").select("lang", "source")
    none = none.join(none.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = sums_of_pairs.unionByName(none)
    of_group = lambda *order: Window.partitionBy("lang", "source").orderBy(F.desc("value"), *order)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(of_group("item")).alias("rank"))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(of_group("chunk", "id"))).where(F.col("rank") <= ranks)
    return pairs.unionByName(terms.select("lang", "source", "part", "item", "value", "rank"))


def audit_sql(least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> str:
    """The same in DuckDB's SQL, in whole numbers of 128 bits."""
    p = lambda n, total: f"1 + {UNIT} * (CAST({n} AS HUGEINT) + 1) // ({total} + v)"
    f = lambda p, q: f"({p} - {q}) * ({p} - {q}) // {q}"
    rank = "CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank"
    return f"""
WITH doc AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
grp AS (SELECT DISTINCT lang, source FROM doc), occ AS (SELECT d, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS n FROM occ GROUP BY 1, 2 HAVING count(DISTINCT d) >= {least_docs}),
whole AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
cnt AS (SELECT lang, source, term, count(*) AS n FROM occ JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
tot AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM grp LEFT JOIN cnt USING (lang, source) GROUP BY 1, 2),
dense AS (SELECT tot.lang, tot.source, kept.term, coalesce(cnt.n, 0) AS n, kept.n AS whole_n, {p("coalesce(cnt.n, 0)", "tot.total")} AS p, {p("kept.n", "whole.total")} AS q
FROM tot JOIN kept ON kept.lang = tot.lang JOIN whole ON whole.lang = tot.lang LEFT JOIN cnt ON cnt.lang = tot.lang AND cnt.source = tot.source AND cnt.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
LEFT JOIN (SELECT x.lang AS l, x.source AS s, y.source AS i, sum({f("x.p", "y.p")}) AS value FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) ON l = a.lang AND s = a.source AND i = b.source),
best AS (SELECT lang, source, term AS item, {f("p", "q")} AS value FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, {rank} FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value, {rank} FROM best) WHERE rank <= {ranks}"""
