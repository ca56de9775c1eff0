"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the hashes of the last three lines decides where a chunk ends, so that the same lines are cut alike
wherever they stand and an inserted line moves no boundary beyond its neighbours. Chunks of two or more lines that occur
more than once in the corpus are removed everywhere but at their first place, after their bytes were compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A chunk ends, on average, after this many lines.
MEAN_LINES = 4
#: Multiplier and modulus of the rolling hash.
BASE, MODULUS = 31, (1 << 31) - 1
LEAST_LINES = 2
#: A chunk is very frequent if it makes more than one in so many of all repeated chunks.
HOT = 1000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunked(text: Column) -> Column:
    """Chunks of a text as an array of structs (no, n_lines, body)."""

    def of_lines(lines: Column) -> Column:
        return let(F.transform(lines, line_hash), lambda h: of_hashes(lines, h))

    def of_hashes(lines: Column, h: Column) -> Column:
        zero = F.lit(0).cast("long")
        before = F.slice(F.concat(F.array(zero), h), F.lit(1), F.size(h))
        before2 = F.slice(F.concat(F.array(zero, zero), h), F.lit(1), F.size(h))
        two = F.zip_with(h, before, lambda a, b: a * (BASE * BASE) + b * BASE)
        rolling = F.zip_with(two, before2, lambda a, b: (a + b) % MODULUS)
        last = F.size(h)
        ends = F.filter(F.transform(rolling, lambda r, i: F.when((r % MEAN_LINES == 0) | (i == last - 1), i + 1)), lambda e: e.isNotNull())
        return let(ends, lambda e: cut(lines, e))

    def cut(lines: Column, ends: Column) -> Column:
        starts = F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(ends))
        bounds = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.transform(bounds, lambda x, i: F.struct(i.alias("no"), (x["b"] - x["a"]).alias("n_lines"), F.array_join(F.slice(lines, x["a"] + 1, x["b"] - x["a"]), "\n").alias("body")))

    return let(F.split(text, "\n", -1), of_lines)


def is_removable(chunk: Column) -> Column:
    return (chunk["n_lines"] >= LEAST_LINES) & (F.trim(F.translate(chunk["body"], "\n\r\t", "")) != "")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with repeated chunks removed from the text; the columns ``n_lines`` and ``n_removed`` follow.

    The first place of a chunk, by id and then by place, stays. Null texts stay null and have no lines; an empty text is
    one empty line; a text that loses all its chunks becomes empty. Chunks of white space alone stay. Rows that share
    an id and the text have the same result; of rows that share an id only, equal chunks at the same place both stay.
    A null id comes first. Input columns named ``n_lines`` or ``n_removed`` are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    source = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_row"), F.col(text_col).alias("_text")).where("_text is not null")
    # One row for each removable chunk; two hashes of 64 bits stand for its bytes until they are compared.
    chunks = source.select("_id", "_row", F.inline(F.filter(chunked(F.col("_text")), is_removable))).select("_id", "_row", F.col("no"), "body", F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(1), "body").alias("h2"))
    # Texts are reduced within each task before the shuffle. Chunks of equal hashes and other bytes are left alone.
    repeated = chunks.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("body").alias("low"), F.max("body").alias("high"), F.min(F.struct("_id", "no")).alias("first"))
    repeated = materialize(repeated.where("n > 1 and low = high").select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "first", "n"), "repeated-chunks")
    # Chunks that make a thousandth of all repeated ones each are a thousand at most: they don't meet their rows by key.
    total = repeated.agg(F.sum("n")).first()[0] or 0
    hot = repeated.where(F.col("n") * HOT > total).drop("n")
    rest = repeated.where(F.col("n") * HOT <= total).select(F.col("r1").alias("q1"), F.col("r2").alias("q2"), F.col("first").alias("q_first"))
    known = chunks.drop("body").join(F.broadcast(hot), (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "left")
    # Their places are spread by keys of their own.
    spread = known.withColumn("key", F.when(F.col("r1").isNull(), F.col("h1")).otherwise(F.xxhash64("_id", "_row", "no")))
    met = spread.join(rest, (F.col("key") == F.col("q1")) & (F.col("h2") == F.col("q2")), "left").withColumn("first", F.coalesce("first", "q_first"))
    again = met.where(F.col("first").isNotNull() & ~F.struct("_id", "no").eqNullSafe(F.col("first"))).select("_id", "_row", "no")
    # A document's own chunks: bounded by its text.
    gone = again.groupBy(F.col("_id").alias("g_id"), F.col("_row").alias("g_row")).agg(F.collect_set("no").alias("_gone"))
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["g_id"]) & (F.xxhash64(docs[text_col]) == gone["g_row"]), "left")
    kept = let(chunked(F.col(text_col)), lambda c: F.struct(
        F.array_join(F.transform(F.filter(c, lambda x: ~F.array_contains(F.col("_gone"), x["no"])), lambda x: x["body"]), "\n").alias("text"),
        F.aggregate(F.filter(c, lambda x: F.array_contains(F.col("_gone"), x["no"])), F.lit(0).cast("long"), lambda s, x: s + x["n_lines"]).alias("n"),
    ))
    lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.length(F.col(text_col)) - F.length(F.translate(F.col(text_col), "\n", "")) + 1).cast("long")
    done = joined.withColumn("n_lines", lines).withColumn("_kept", F.when(F.col("_gone").isNotNull(), kept))
    done = done.withColumn("n_removed", F.coalesce(F.col("_kept.n"), F.lit(0).cast("long"))).withColumn(text_col, F.coalesce(F.col("_kept.text"), F.col(text_col)))
    return done.select(*docs.columns, "n_lines", "n_removed")


def dedup_sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL, as one table expression with columns doc_id, text, n_lines, n_removed.

    For tables of one row for each id.
    """
    return f"""
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS i FROM {table} WHERE text IS NOT NULL
), hashed AS (
  SELECT *, CAST('0x' || substr(md5(body), 1, 8) AS BIGINT) AS h FROM line
), rolled AS (
  SELECT *, (h * {BASE * BASE} + coalesce(lag(h) OVER w, 0) * {BASE} + coalesce(lag(h, 2) OVER w, 0)) % {MODULUS} AS r FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(CASE WHEN r % {MEAN_LINES} = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM rolled
), chunk AS (
  SELECT doc_id, no, count(*) AS n_lines, string_agg(body, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, no
), marked AS (
  SELECT *, n_lines >= {LEAST_LINES} AND trim(translate(body, chr(10) || chr(13) || chr(9), '')) <> '' AS removable FROM chunk
), ranked AS (
  SELECT *, removable AND row_number() OVER (PARTITION BY body, removable ORDER BY doc_id, no) > 1 AS gone FROM marked
), rebuilt AS (
  SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text, sum(n_lines) AS n_lines, coalesce(sum(n_lines) FILTER (gone), 0) AS n_removed FROM ranked GROUP BY doc_id
)
SELECT d.doc_id, r.text AS text, CAST(coalesce(r.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed FROM {table} d LEFT JOIN rebuilt r USING (doc_id)"""
