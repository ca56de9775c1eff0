"""Quality classifier as a sparse rule ensemble.

Statistics of a text are numbers; the paths of small trees grown on them are rules, conjunctions of bounds. A lasso
logistic regression over the rules (1 where all bounds hold) keeps a few and weights them. The kept rules are compiled
into one Spark column expression over the statistics.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import id_and_text, materialize, text_batches

#: Labelled rows that the model is fitted on: about this many, chosen by the hash of the id; all if there are fewer.
SAMPLE_ROWS = 20_000
TREES, DEPTH, SEED = 24, 3, 7
#: Strength of the lasso.
LASSO = 0.001
#: Steps of the lasso at most, and the relative change of its loss at which it ends.
MOST_STEPS, TOLERANCE = 100, 1e-5

STATISTICS = [
    "chars", "words", "word_length", "upper", "digit", "punct", "exclaim", "bar", "sign", "signed_words", "caps_words",
    "lone_punct_words", "same_as_previous", "distinct_words", "line_words", "repeated_lines", "beyond_ascii",
]

UPPER, LOWER_, DIGIT, BEYOND = (np.zeros(256, dtype=bool) for _ in range(4))
UPPER[0x41:0x5B] = True
LOWER_[0x61:0x7B] = True
DIGIT[0x30:0x3A] = True
BEYOND[0x80:] = True
PUNCT = ~(UPPER | LOWER_ | DIGIT | BEYOND | K.SPACE)
PUNCT[:0x20] = False
SIGN = np.zeros(256, dtype=bool)
SIGN[[*b"#$%&*<>=@^_~{}[]\\/+"]] = True


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text; an empty text has zeros."""
    words = K.Words(texts, ~K.SPACE, lower=False)
    n, raw = words.n, words.bytes
    out = np.zeros((len(texts), len(STATISTICS)))
    put = dict(zip(STATISTICS, range(len(STATISTICS))))
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    n_bytes = np.maximum(np.diff(bounds) - 1, 1)

    def share(table: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(table[raw])])[bounds])

    def of_words(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[words.first])

    counts = words.per_text()
    some = np.maximum(counts, 1)
    upper, lower, beyond = share(UPPER), share(LOWER_), share(BEYOND)
    out[:, put["chars"]] = np.log1p(np.diff(bounds) - 1)
    out[:, put["words"]] = np.log1p(counts)
    out[:, put["upper"]] = upper / np.maximum(upper + lower + beyond, 1)
    out[:, put["digit"]] = share(DIGIT) / n_bytes
    out[:, put["punct"]] = share(PUNCT) / n_bytes
    out[:, put["sign"]] = share(SIGN) / n_bytes
    out[:, put["beyond_ascii"]] = beyond / n_bytes
    for name, byte in (("exclaim", b"!"), ("bar", b"|")):
        one = np.zeros(256, dtype=bool)
        one[byte[0]] = True
        out[:, put[name]] = share(one) / n_bytes
    if not n:
        return out
    length = words.ends - words.starts

    def in_word(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[raw])])
        return sums[words.ends] - sums[words.starts]

    hashes = words.hashes()
    text = words.text_of()
    out[:, put["word_length"]] = of_words(length) / some
    out[:, put["signed_words"]] = of_words(in_word(SIGN) >= 2) / some
    caps = in_word(UPPER)
    out[:, put["caps_words"]] = of_words((caps >= 2) & (in_word(LOWER_) == 0)) / some
    out[:, put["lone_punct_words"]] = of_words(in_word(PUNCT) == length) / some
    same = np.zeros(n, dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    out[:, put["same_as_previous"]] = of_words(same) / some
    # Share of distinct words in passages of 64 words: unlike that of a whole text, it doesn't fall with its length.
    block = text * (1 << 24) + (np.arange(n) - words.first[text]) // 64
    order = np.lexsort((hashes, block))
    new = np.ones(n, dtype=bool)
    new[order[1:]] = (hashes[order[1:]] != hashes[order[:-1]]) | (block[order[1:]] != block[order[:-1]])
    out[:, put["distinct_words"]] = of_words(new) / some
    lines = K.Words(texts, np.arange(256) != 0x0A, lower=False)
    line_counts = np.maximum(lines.per_text(), 1)
    out[:, put["line_words"]] = np.log1p(counts / line_counts)
    line_text, line_hash = lines.text_of(), lines.hashes()
    order = np.lexsort((line_hash, line_text))
    again = (line_hash[order[1:]] == line_hash[order[:-1]]) & (line_text[order[1:]] == line_text[order[:-1]])
    out[:, put["repeated_lines"]] = np.bincount(line_text[order[1:]][again], minlength=len(texts)) / line_counts
    return out


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, STATISTICS...), one per row of ``docs``; null and empty texts have zeros."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids,), texts in text_batches(batches, ["doc_id"]):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c) for c in statistics(texts).T)], names=["doc_id", *STATISTICS])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


#: A bound: statistic, whether it is an upper bound (<=), threshold.
Bound = tuple[str, bool, float]


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[tuple[Bound, ...], float]]  # conjunctions and their weights

    def score(self) -> Column:
        """Probability of label 1 as a column expression over the statistics."""
        total = F.lit(self.intercept)
        for bounds, weight in self.rules:
            total = total + F.when(holds(bounds), weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(bounds: tuple[Bound, ...]) -> Column:
    both = None
    for name, upper, threshold in bounds:
        one = F.col(name) <= threshold if upper else F.col(name) > threshold
        both = one if both is None else both & one
    return both


_SPLIT = re.compile(r"(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def tree_rules(description: str) -> list[tuple[Bound, ...]]:
    """All paths from the root, to inner nodes as well as leaves, of a tree as ``toDebugString`` prints it."""
    rules, path = [], []
    for line in description.splitlines():
        if m := _SPLIT.match(line):
            path = [p for p in path if p[0] < len(m[1])] + [(len(m[1]), (STATISTICS[int(m[3])], m[4] == "<=", float(m[5])))]
            rules.append(simplify(tuple(b for _, b in path)))
    return rules


def simplify(bounds: tuple[Bound, ...]) -> tuple[Bound, ...]:
    """The tightest bound of each statistic and side, in a fixed order."""
    best: dict[tuple[str, bool], float] = {}
    for name, upper, threshold in bounds:
        have = best.get((name, upper))
        best[name, upper] = threshold if have is None else min(have, threshold) if upper else max(have, threshold)
    return tuple((name, upper, t) for (name, upper), t in sorted(best.items()))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on about ``sample_rows`` labelled documents; the labels of an id that is repeated count as their smallest.

    Labels without a document, and null ids and labels, are left out. With labels of one kind only, or none, the
    score is a constant.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("double").alias("label"))
    n = marks.count()
    share = min(1.0, sample_rows / max(n, 1))
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    picked = docs.join(F.broadcast(chosen), docs[id_col] == chosen["doc_id"], "left_semi")  # about sample_rows ids
    # The sample is bounded: in two parts, each of the many small jobs of a fit has two tasks.
    table = materialize(with_statistics(picked, id_col, text_col).join(F.broadcast(chosen), "doc_id").repartition(2, "doc_id"), "labelled").persist()
    kinds = {r["label"]: r["count"] for r in table.groupBy("label").count().collect()}
    if len(kinds) < 2:
        table.unpersist()
        p = (sum(k * v for k, v in kinds.items()) + 0.5) / (sum(kinds.values()) + 1)
        return RuleModel(float(np.log(p / (1 - p))), [])
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(table)
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="onethird", seed=SEED).fit(vectors)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in tree_rules(tree.toDebugString)))
    ruled = table.select("label", *(holds(r).cast("double").alias(f"rule{k}") for k, r in enumerate(rules)))
    vectors = VectorAssembler(inputCols=[f"rule{k}" for k in range(len(rules))], outputCol="features").transform(ruled)
    lasso = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=LASSO, maxIter=MOST_STEPS, tol=TOLERANCE, standardization=False).fit(vectors)
    table.unpersist()
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if abs(w) > 1e-6]
    return RuleModel(float(lasso.intercept), kept)


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score), one per row of ``docs``; empty and null texts are scored by their zeros."""
    return with_statistics(docs, id_col, text_col).select("doc_id", model.score().alias("score"))
