"""Language identification: script ranges narrow the candidates, Viterbi labels spans of mixed-language text.

Training counts, for each language, hashed character trigrams of words and the scripts of letters, as Spark
aggregations. A word's score for a language is the sum of its trigrams' log-probabilities, among the languages that
write its script. A path through the words of a text takes each word's score and pays a penalty whenever the language
changes; the best path's runs are the spans of the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, text_batches

#: Hashed trigrams of the model.
FEATURES = 1 << 16
#: Documents of each language that the model is fitted on: about this many, chosen by the hash of the text.
SAMPLE_PER_LANGUAGE = 4000
#: What a change of language costs, in nats; about the evidence of two or three clear words.
SWITCH_PENALTY = 12.0
#: Evidence of one word is cut off at this distance from the best language.
WORD_CAP = 8.0
#: A language writes a script if at least this share of its letters is of it.
SCRIPT_SHARE = 0.005
UNDETERMINED = "und"

#: First and last code points of script ranges (fixed values of the Unicode block list); what is in none is "other".
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2AF), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x373), (0x376, 0x377), (0x37B, 0x37D), (0x37F, 0x37F), (0x386, 0x386), (0x388, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x481), (0x48A, 0x52F)],
    "armenian": [(0x531, 0x556), (0x561, 0x587)],
    "hebrew": [(0x5D0, 0x5EA)],
    "arabic": [(0x620, 0x64A), (0x66E, 0x6D3), (0x750, 0x77F)],
    "devanagari": [(0x904, 0x939), (0x958, 0x961)],
    "bengali": [(0x985, 0x9B9)],
    "tamil": [(0xB85, 0xBB9)],
    "thai": [(0xE01, 0xE30)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7A3)],
    "kana": [(0x3041, 0x3096), (0x30A1, 0x30FA)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
SCRIPT_NAMES = ["none", *SCRIPTS, "other"]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Script and lower case of every code point of the basic plane."""
    script = np.zeros(1 << 16, dtype=np.uint8)
    lower = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if ch.isalpha():
            script[c] = len(SCRIPT_NAMES) - 1
        if len(ch.lower()) == 1:
            lower[c] = ord(ch.lower())
    for k, ranges in enumerate(SCRIPTS.values(), start=1):
        for a, b in ranges:
            block = script[a : b + 1]
            block[block > 0] = k
    return script, lower


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES.append(_tables())
    return _TABLES[0]


class Letters:
    """Words of letters of a batch of texts, with their trigrams and scripts."""

    def __init__(self, texts: list[bytes]) -> None:
        script, lower = tables()
        joined = b"\n".join(texts).decode("utf-8", "replace") + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        beyond = codes >= 1 << 16
        plane = np.where(beyond, 0, codes)
        kinds = script[plane]
        if beyond.any():
            kinds = kinds.copy()
            kinds[beyond] = [len(SCRIPT_NAMES) - 1 if chr(c).isalpha() else 0 for c in codes[beyond]]
        inside = kinds > 0
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[0::2], edges[1::2]
        lengths = np.array([len(t) if t.isascii() else len(t.decode("utf-8", "replace")) for t in texts], dtype=np.int64)
        self.text_ends = np.cumsum(lengths + 1)
        self.first = np.concatenate([[0], np.searchsorted(self.starts, self.text_ends)]).astype(np.int64)
        self.kinds = kinds[self.starts]  # a word's script is that of its first letter
        self.length = self.ends - self.starts
        low = np.where(inside, np.where(beyond, codes, lower[plane]), np.uint32(0)).astype(np.uint64)
        # trigrams around each letter; a word's neighbours count as 0, so starts and ends of words show
        with np.errstate(over="ignore"):
            mixed = low * np.uint64(0x9E3779B97F4A7C15)
            mixed[1:] += low[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
            mixed[:-1] += low[1:] * np.uint64(0x165667B19E3779F9)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
        self.trigrams = (mixed >> np.uint64(48)).astype(np.int64)
        self.inside = inside

    def by_word(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value for every letter (rows) over each word."""
        return np.add.reduceat(values, self.starts) if len(self.starts) else np.zeros((0, values.shape[1]), dtype=values.dtype)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # FEATURES + 1 rows, the last for no letter; a column for each language
    writes: np.ndarray  # script by language: whether the language writes it
    usual: int = 0  # the language with most letters, for letters that none of the languages write


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on rows with a language and a text: about ``per_language`` of each, all if there are fewer.

    The rows are those whose text hashes lowest. Counting is distributed; the driver gets a table of at most
    FEATURES rows for each language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((FEATURES + 1, 0)), np.zeros((len(SCRIPT_NAMES), 0), dtype=bool))
    names = sorted(sizes)
    # The share that gives about per_language rows, by language.
    limit = F.lit(0.0)
    for name in names:
        limit = F.when(F.col("lang") == name, min(1.0, per_language / sizes[name])).otherwise(limit)
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < limit * (1 << 20))
    place = {n: k for k, n in enumerate(names)}
    scripts = len(SCRIPT_NAMES)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), FEATURES + scripts), dtype=np.int64)
        for (langs,), texts in text_batches(batches, ["lang"]):
            letters = Letters(texts)
            words = np.repeat(np.array([place[x] for x in langs]), np.diff(letters.first))
            of_letter = np.repeat(words, letters.length)
            seen = letters.trigrams[letters.inside]
            total[:, :FEATURES] += np.bincount(of_letter * FEATURES + seen, minlength=len(names) * FEATURES).reshape(len(names), FEATURES)
            total[:, FEATURES:] += np.bincount(words * scripts + letters.kinds, weights=letters.length, minlength=len(names) * scripts).reshape(len(names), scripts).astype(np.int64)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(at[0], pa.int32()), "feature": pa.array(at[1], pa.int32()), "n": pa.array(total[at], pa.int64())})

    counts = np.zeros((len(names), FEATURES + scripts))
    summed = chosen.mapInArrow(count, "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    got = summed.toPandas()  # at most (FEATURES + scripts) rows for each language
    counts[got["lang"].to_numpy(), got["feature"].to_numpy()] = got["n"].to_numpy()
    trigrams = counts[:, :FEATURES] + 0.5
    scores = np.log(trigrams / trigrams.sum(axis=1, keepdims=True)).T
    letters = counts[:, FEATURES:]
    writes = (letters >= SCRIPT_SHARE * letters.sum(axis=1, keepdims=True)) & (letters > 0)
    return Model(names, np.vstack([scores, np.zeros(len(names))]).astype(np.float32), writes.T, int(letters.sum(axis=1).argmax()))


def word_scores(letters: Letters, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scores of each word by language, and the words that say something: some language writes their script."""
    at = np.where(letters.inside, letters.trigrams, FEATURES)
    scores = letters.by_word(model.scores[at])
    may = model.writes[letters.kinds]
    told = may.any(axis=1)
    scores = np.where(may, scores, -np.inf)
    best = scores.max(axis=1, keepdims=True, initial=-np.inf)
    scores = np.maximum(scores - np.where(told[:, None], best, 0), -WORD_CAP)
    scores[~told] = 0
    return scores, told


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word: all texts of a batch advance together, a word at a time."""
    n_words, k = scores.shape
    labels = np.zeros(n_words, dtype=np.int32)
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    starts, counts = first[:-1][order], counts[order]
    longest = int(counts[0]) if len(counts) else 0
    if not longest or not k:
        return labels
    alive = np.searchsorted(-counts, -np.arange(longest), side="left")  # texts with more than t words
    back = np.zeros((n_words, k), dtype=np.int16)
    v = np.zeros((len(counts), k))
    own = np.arange(k, dtype=np.int16)
    for t in range(longest):
        a = int(alive[t])
        at = starts[:a] + t
        if t:
            w = v[:a]
            top = w.argmax(axis=1)
            jump = w[np.arange(a), top][:, None] - penalty
            stay = w >= jump
            back[at] = np.where(stay, own, top[:, None])
            v[:a] = np.where(stay, w, jump) + scores[at]
        else:
            v[:a] = scores[at]
    state = v.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        a = int(alive[t])
        at = starts[:a] + t
        labels[at] = state[:a]
        state[:a] = back[at, state[:a]]
    return labels


def label_batch(texts: list[bytes], model: Model, penalty: float = SWITCH_PENALTY) -> tuple[list[str], np.ndarray, list[list[tuple[str, int, int]]]]:
    """Of each text: the language with most letters on the best path, its share of confidence, and the spans."""
    letters = Letters(texts)
    scores, told = word_scores(letters, model)
    labels = viterbi(scores, letters.first, penalty)
    k = len(model.languages)
    counts = np.diff(letters.first)
    text = np.repeat(np.arange(len(texts)), counts)
    weight = np.zeros((len(texts), max(k, 1)))
    np.add.at(weight, (text[told], labels[told]), letters.length[told])
    total = weight.sum(axis=1)
    best = weight.argmax(axis=1)
    share = np.divide(weight.max(axis=1), total, out=np.zeros(len(texts)), where=total > 0)
    some = (counts > 0) & (k > 0)
    names = [model.languages[b if t else model.usual] if s else UNDETERMINED for b, t, s in zip(best, total, some)]
    spans: list[list[tuple[str, int, int]]] = []
    text_starts = np.concatenate([[0], letters.text_ends[:-1]])
    for i in range(len(texts)):
        a, b = letters.first[i], letters.first[i + 1]
        own = np.flatnonzero(told[a:b]) + a
        cuts = np.flatnonzero(labels[own][1:] != labels[own][:-1]) + 1 if len(own) else []
        spans.append([(model.languages[labels[p[0]]], int(letters.starts[p[0]] - text_starts[i]), int(letters.ends[p[-1]] - text_starts[i])) for p in np.split(own, cuts) if len(p)])
    return names, share, spans


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Rows (doc_id, lang_pred, score, spans), one per row of ``docs``.

    ``score`` is the language's share of the letters that any language claims. ``spans`` are (lang, start, end) in
    characters. Null and empty texts and texts without letters give ``und`` and score 0, without spans; letters
    that no language of the model writes give its usual language and score 0. Only the id and text columns are read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # FEATURES rows of numbers for each language
    span = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids,), texts in text_batches(batches, ["doc_id"]):
            names, share, spans = label_batch(texts, shared.value, penalty)
            rows = [[{"lang": x, "start": a, "end": b} for x, a, b in s] for s in spans]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "lang_pred": pa.array(names, pa.string()), "score": pa.array(share, pa.float64()), "spans": pa.array(rows, pa.list_(span))})

    return id_and_text(docs, id_col, text_col).mapInArrow(label, "doc_id long, lang_pred string, score double, spans array<struct<lang: string, start: long, end: long>>")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.5, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Rows of ``docs`` whose text has a language with at least ``least_score`` of its letters; columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[bool] = []
            for _, texts in text_batches([batch], [], text_col):
                names, share, _ = label_batch(texts, shared.value, penalty)
                kept += [n != UNDETERMINED and s >= least_score for n, s in zip(names, share)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def fold(id_col: str, folds: int) -> Column:
    """Fold of a row: crc32 of its id as text; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))
