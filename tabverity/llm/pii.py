"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base matches of four kinds (email, ip, card, phone) are the seeds. Candidates are tokens with a digit or an at sign and
sequences of up to four of them. A candidate has several lexical patterns: its shape digit by digit, with a mark where a
card's check digit holds; and its shape by runs with one, two or three words before it, or one word on either side.
Patterns and candidates' texts (instances) make a graph. In every round a pattern's score is the mean score of what it
extracts, seen with the share of seeds among all candidates of the shape, and an instance's the best score of its
patterns, a little less as it isn't a seed. Candidates of patterns with a high score and enough distinct seeds are added
as spans, and those whose text is a seed elsewhere. So found are identifiers that the base expressions lose, such as a
card or phone number that runs into the next number, and those that only their context tells.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Base expressions. Each is the plain one with possessive repeats and, for emails and addresses, a start that is no
#: continuation of a failed one (the matches are the same): so time is linear in long runs of one class.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's expression to be worth running.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: A token with a digit or an at sign.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Tokens of a candidate at most.
MOST_TOKENS = 4
#: Characters around a token that its context is taken from, and of each word there.
CONTEXT_CHARS, WORD_CHARS = 64, 24
ROUNDS = 3
#: A pattern is trusted from this score, and with this many distinct seed instances, on.
LEAST_SCORE, LEAST_SEEDS = 0.8, 3
#: Weight of the shape's own share of seeds in a pattern's score, in candidates; what an instance keeps of a pattern's score.
PRIOR, DAMPING = 1.0, 0.9


def _pieces(kind: str, pattern: str, text: Column, context: bool = False) -> Column:
    """Matches of a text in order: (kind, idx, gap: characters before it since the last one, body[, joins, left, right]).

    ``joins`` tells whether one space alone lies between it and the match before.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    fields = lambda m, i: [F.lit(kind).alias("kind"), i.alias("idx"), F.length(m["g"]).alias("gap"), m["m"].alias("body")]
    if not context:
        return F.transform(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), lambda m, i: F.struct(*fields(m, i)))
    # The text before a match, from its last words on, over the gaps and matches before it.
    last = lambda x: F.right(x, F.lit(CONTEXT_CHARS))
    ahead = lambda a, n: F.slice(F.concat(F.array_repeat(F.lit(""), n), a), F.lit(1), F.size(found))
    ends = F.zip_with(gaps, found, lambda g, m: last(F.concat(last(g), last(m))))
    before = F.zip_with(F.zip_with(ahead(ends, 2), ahead(ends, 1), lambda a, b: F.concat(a, b)), gaps, lambda b, g: last(F.concat(b, last(g))))
    after = F.transform(F.slice(F.split(text, pattern, -1), F.lit(2), F.size(found)), lambda g: F.left(g, F.lit(CONTEXT_CHARS)))
    matched = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    around = F.zip_with(before, after, lambda b, r: F.struct(b.alias("left"), r.alias("right")))
    both = F.zip_with(matched, around, lambda p, c: F.struct(p["g"].alias("g"), p["m"].alias("m"), c["left"].alias("left"), c["right"].alias("right")))
    return F.transform(both, lambda m, i: F.struct(*fields(m, i), (m["g"] == " ").alias("joins"), m["left"].alias("left"), m["right"].alias("right")))


def _when_hinted(kind: str, text: Column, pieces: Column) -> Column:
    """Pieces of a text, without running the expression where it can't match."""
    hint = HINTS.get(kind)
    worth = text.contains(hint) if hint else text.rlike("[0-9]")
    return F.when(worth, pieces).otherwise(F.array().cast("array<struct<kind:string,idx:int,gap:int,body:string>>"))


def _placed(rows: DataFrame) -> DataFrame:
    """Start and end, in characters, of each match of a document and kind."""
    w = Window.partitionBy("doc_id", "row", "kind").orderBy("idx")
    end = F.sum(F.col("gap") + F.length("body")).over(w)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("body"))


def digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def is_valid(kind: Column, body: Column) -> Column:
    """The check of a kind on a match."""
    n = F.length(digits(body))
    bare = lambda x: F.regexp_replace(x, "^0+", "")
    small = F.forall(F.split(body, r"\."), lambda x: (F.length(bare(x)) <= 3) & (F.coalesce(bare(x).try_cast("int"), F.lit(0)) <= 255))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", n.between(13, 19) & F.call_function("luhn_check", digits(body)))
        .when(kind == "phone", n.between(9, 15))
    )


def base_spans(source: DataFrame) -> DataFrame:
    """Rows (doc_id, row, kind, start, end, body) of the valid base matches; ``source`` has doc_id, row, text."""
    text = F.col("text")
    pieces = F.concat(*(_when_hinted(k, text, _pieces(k, PATTERNS[k], text)) for k in KINDS))
    rows = source.where(text.rlike("[0-9@]")).select("doc_id", "row", F.inline(pieces)).dropDuplicates(["doc_id", "row", "kind", "idx"])
    return _placed(rows).where(is_valid(F.col("kind"), F.col("body"))).select("doc_id", "row", "kind", "start", "end", "body")


def _plain_word(word: Column) -> Column:
    """A word of a context; numbers and addresses count as one word each."""
    return F.when(word.contains("@"), "@").otherwise(F.right(F.regexp_replace(F.lower(word), "[0-9]+", "0"), F.lit(WORD_CHARS)))


def _words(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), _plain_word)


def candidates(source: DataFrame) -> DataFrame:
    """Rows (doc_id, row, start, end, body, left, right) of all candidates; left: the words before, nearest first."""
    text = F.col("text")
    rows = source.where(text.rlike("[0-9@]")).select("doc_id", "row", F.inline(_pieces("token", TOKEN, text, context=True))).dropDuplicates(["doc_id", "row", "idx"])
    w = Window.partitionBy("doc_id", "row").orderBy("idx")
    following = [F.struct(F.lead("body", k).over(w).alias("body"), F.lead("joins", k).over(w).alias("joins"), F.lead("right", k).over(w).alias("right")).alias(f"t{k}") for k in range(1, MOST_TOKENS)]
    placed = _placed(rows).select("*", *following)
    body, open_, made = F.col("body"), F.lit(True), []
    for k in range(MOST_TOKENS):
        if k:
            # A token that ends in a comma or the like ends the candidate.
            open_ = open_ & F.coalesce(F.col(f"t{k}.joins"), F.lit(False)) & ~body.rlike("[,;:!?]$")
            body = F.concat(body, F.lit(" "), F.col(f"t{k}.body"))
        made.append(F.when(open_, F.struct(body.alias("raw"), (F.col(f"t{k}.right") if k else F.col("right")).alias("right"))))
    long = placed.select("doc_id", "row", "start", F.col("left").alias("before"), F.inline(F.array_compact(F.array(*made))))
    # Signs around it don't belong to it, nor does a bracket without its other half.
    lead = F.length(F.regexp_extract("raw", r"^[^\p{L}\p{N}+(]*+(?:\((?=[^)]*+$))?", 0))
    core = F.expr("substring(raw, lead + 1)")
    core = F.regexp_extract(core, r"^(?s:.*[\p{L}\p{N})])", 0)
    core = F.when(core.contains("("), core).otherwise(F.regexp_replace(core, r"\)+$", ""))
    out = long.withColumn("lead", lead).withColumn("body", core).withColumn("start", F.col("start") + F.col("lead")).where("body <> ''")
    left = F.slice(F.reverse(_words(F.col("before"))), 1, 3)
    return out.select("doc_id", "row", "start", (F.col("start") + F.length("body")).alias("end"), "body", left.alias("left"), F.coalesce(F.get(_words(F.col("right")), F.lit(0)), F.lit("")).alias("right"))


def _patterns() -> Column:
    """The patterns of a candidate, as text."""
    letters = F.regexp_replace(F.lower("body"), r"\p{L}+", "a")
    fine, coarse = F.left(F.regexp_replace(letters, "[0-9]", "0"), F.lit(64)), F.left(F.regexp_replace(letters, "[0-9]+", "0"), F.lit(48))
    checked = F.when(F.length(digits(F.col("body"))).between(13, 19) & ~F.lower("body").rlike(r"\p{L}|@") & is_valid(F.lit("card"), F.col("body")), "checked ").otherwise("")
    word = lambda k: F.get("left", F.lit(k))
    parts = [F.concat(F.lit("digits "), checked, fine)]
    parts += [F.when(F.size("left") >= k, F.concat_ws("\x01", F.lit(f"left{k}"), *map(word, range(k)), coarse)) for k in (1, 2, 3)]
    parts.append(F.when((F.size("left") >= 1) & (F.col("right") != ""), F.concat_ws("\x01", F.lit("both"), word(0), F.col("right"), coarse)))
    return F.array_compact(F.array(*parts)), coarse


def with_seeds(found: DataFrame, base: DataFrame) -> DataFrame:
    """Candidates with the kind of the base match that they are (``seed``); those that only overlap one are left out."""
    # A document's own matches: bounded by its text.
    own = base.groupBy(F.col("doc_id").alias("b_id"), F.col("row").alias("b_row")).agg(F.collect_list(F.struct("start", "end", "kind")).alias("own"))
    joined = found.join(own, found["doc_id"].eqNullSafe(own["b_id"]) & (found["row"] == own["b_row"]), "left")
    same = F.filter("own", lambda b: (b["start"] == F.col("start")) & (b["end"] == F.col("end")))
    overlaps = F.coalesce(F.exists("own", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"])), F.lit(False))
    patterns, shape = _patterns()
    marked = joined.withColumn("seed", F.get(same, F.lit(0))["kind"]).where(F.col("seed").isNotNull() | ~overlaps)
    return marked.select("doc_id", "row", "start", "end", "body", "seed", shape.alias("shape"), patterns.alias("patterns"))


def bootstrap(found: DataFrame, rounds: int = ROUNDS, least_score: float = LEAST_SCORE, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """Trusted patterns: rows (pattern, kind, score), one kind for a pattern."""
    # The graph: how often each pattern extracts each instance. Mentions of one text repeated count in full.
    edges = found.select(F.explode("patterns").alias("pattern"), "shape", "body", "seed").groupBy("pattern", "shape", "body", "seed").agg(F.count("*").alias("n"))
    kinds = found.groupBy("shape").agg(F.count("*").alias("of_shape"), *(F.sum(F.when(F.col("seed") == k, 1).otherwise(0)).alias(k) for k in KINDS))
    share = kinds.where("+".join(KINDS) + " > 0").select("shape", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), (F.col(k) / F.col("of_shape")).alias("share")) for k in KINDS)))).where("share > 0")
    edges = materialize(edges, "mention-graph")
    able = edges.where("seed is not null").groupBy("pattern").agg(F.count_distinct("body").alias("seeds")).where(F.col("seeds") >= least_seeds).select("pattern")
    edges, share = materialize(edges.join(able, "pattern", "left_semi"), "mention-graph"), materialize(share, "shapes")
    seeds = edges.where("seed is not null").groupBy("body").agg(F.min("seed").alias("kind"))
    score, patterns = None, None
    for _ in range(rounds):
        own = F.col("seed").alias("kind"), F.lit(1.0).alias("instance_score")
        scored = edges.where("seed is not null").select("pattern", "shape", "body", "n", "seed", *own)
        if score is not None:
            scored = scored.unionByName(edges.where("seed is null").join(score, "body").select("pattern", "shape", "body", "n", "seed", "kind", "instance_score"))
        total = edges.groupBy("pattern").agg(F.sum("n").alias("all"))
        by_kind = scored.groupBy("pattern", "shape", "kind").agg(F.sum(F.col("n") * F.col("instance_score")).alias("mass"), F.count_distinct(F.when(F.col("seed").isNotNull(), F.col("body"))).alias("seeds"))
        by_kind = by_kind.join(share, ["shape", "kind"]).join(total, "pattern").withColumn("score", (F.col("mass") + PRIOR * F.col("share")) / (F.col("all") + PRIOR))
        by_kind = by_kind.where((F.col("score") >= least_score) & (F.col("seeds") >= least_seeds))
        patterns = materialize(by_kind.groupBy("pattern").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score")), "patterns")
        reached = edges.where("seed is null").join(patterns, "pattern").groupBy("body").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), (F.max("score") * DAMPING).alias("instance_score"))
        # An instance that is a seed elsewhere keeps its kind and full score.
        known = seeds.withColumn("instance_score", F.lit(1.0))
        score = materialize(known.unionByName(reached.join(seeds.select("body"), "body", "left_anti")), "instances")
    return patterns


def _apart(spans: Column) -> Column:
    """Of spans in order of preference, those that overlap none before."""
    none = F.array().cast("array<struct<score:double,length:bigint,start:bigint,end:bigint,kind:string>>")
    return F.aggregate(spans, none, lambda kept, x: F.when(F.exists(kept, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])), kept).otherwise(F.concat(kept, F.array(x))))


def discover(found: DataFrame, trusted: DataFrame) -> DataFrame:
    """Rows (doc_id, row, kind, start, end) of the candidates that trusted patterns or known instances add."""
    unseen = found.where("seed is null")
    by_pattern = unseen.select("doc_id", "row", "start", "end", F.explode("patterns").alias("pattern")).join(trusted, "pattern")
    seeds = found.where("seed is not null").groupBy("body").agg(F.min("seed").alias("kind"))
    by_body = unseen.select("doc_id", "row", "start", "end", "body").join(seeds, "body").withColumn("score", F.lit(1.0))
    both = by_pattern.select("doc_id", "row", "start", "end", "kind", "score").unionByName(by_body.select("doc_id", "row", "start", "end", "kind", "score"))
    best = both.groupBy("doc_id", "row", "start", "end").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"))
    # The best ones of a document that don't overlap: longer ones first, then by score.
    span = F.struct("score", (F.col("end") - F.col("start")).alias("length"), "start", "end", "kind")
    before = lambda a, b: F.when(a["length"] != b["length"], F.signum(b["length"] - a["length"])).when(a["score"] != b["score"], F.signum(b["score"] - a["score"])).otherwise(F.signum(a["start"] - b["start"])).cast("int")
    by_doc = best.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(span), before).alias("spans"))
    return by_doc.select("doc_id", "row", F.inline(_apart(F.col("spans")))).select("doc_id", "row", "kind", "start", "end")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, base, spans), one per row of ``docs``: arrays of (kind, start, end), characters, end exclusive.

    ``base`` holds the base matches, ``spans`` those and the candidates that bootstrapping added, which overlap no other
    span, by kind as in KINDS and then by start. Null and empty texts have none. Only the id and text columns are read; rows that share an id and the
    text have the same spans.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    base = materialize(base_spans(source), "base-spans")
    found = materialize(with_seeds(candidates(source), base), "candidates")
    unseen = discover(found, bootstrap(found))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct(order.alias("order"), "start", "end", "kind")
    every = base.select("doc_id", "row", span.alias("span"), F.lit(True).alias("is_base")).unionByName(unseen.select("doc_id", "row", span.alias("span"), F.lit(False).alias("is_base")))
    # A document's own matches: bounded by its text.
    by_doc = every.groupBy(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row")).agg(F.sort_array(F.collect_list(F.when(F.col("is_base"), F.col("span")))).alias("base"), F.sort_array(F.collect_list(F.when(~F.col("is_base"), F.col("span")))).alias("more"))
    by_doc = by_doc.select("of_id", "of_row", "base", F.sort_array(F.concat("base", "more")).alias("spans"))
    keys = source.select("doc_id", "row")
    none = F.array().cast("array<struct<order:bigint,start:bigint,end:bigint,kind:string>>")
    joined = keys.join(by_doc, keys["doc_id"].eqNullSafe(by_doc["of_id"]) & (keys["row"] == by_doc["of_row"]), "left")
    return joined.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def _text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _if_kind(kind: str, span: Column) -> Column:
    return F.when(span["kind"] == kind, 1)


def spans_digest(found: DataFrame) -> DataFrame:
    counts = [F.size(F.array_compact(F.transform("base", partial(_if_kind, k)))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_text("base").cast("binary"), 256).alias("base_sha256"), _text("spans").alias("spans"))
