"""BPE encoding and decoding, with long texts encoded by tree concatenation.

White space never lies inside a token, so a text is encoded by its pieces (what the vocabulary's splitting leaves), and
each distinct piece only once while it stays in a bounded memory. A long text is cut into halves until the parts are
short; Spark encodes the parts in parallel. Where a cut lies inside a run without white space, windows around the joint
are encoded again, each twice as wide, until the window's tokens agree with the left part's at its left and with the
right part's at its right: from an equal token on, both sides continue alike, so the concatenation is the encoding of
the whole.

The vocabulary file is a parameter (``Tokenizer.from_file``); it is read by every task from the path given, which
has to be readable on the executors.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REMEMBERED, id_and_text, row_key, text_batches

#: Characters of a text beyond which it is cut into halves.
PART_CHARS = 1 << 13
#: Characters beside a joint in the first window; doubled until both sides agree.
WINDOW = 32
#: Distinct pieces of at most so many characters that a Python worker remembers (about 25 MB); of other runs, an eighth
#: as many.
MEMORY, PIECE_CHARS = 80_000, 64
#: Tokens: ids, and where each starts and ends in the text.
Tokens = tuple[list[int], list[int], list[int]]


def load_tokenizer(path: str):
    """The tokenizers library's tokenizer of a vocabulary file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes are themselves, the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


BYTE_LETTERS = _byte_letters()
#: Texts of these characters are split by _PIECES as by the vocabulary's own expression: all are composed, have simple
#: lower case, and are letters beyond ASCII. "<|" may begin a special token.
_PLAIN = re.compile(r"[\t-\r -~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u0148\u014A-\u017F]*")
_PIECES = re.compile(r"[a-z\u00DF-\u017F]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\sa-z0-9\u00DF-\u017F]+")
#: Normaliser and splitting (fixed values of the public vocabulary file) for which the above holds.
_PLAIN_SETUP = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}


class Pieces(dict):
    """Values of pieces of lower-case text, learned by the vocabulary's merges; forgets all when it is full."""

    def __init__(self, model, value: Callable[[list[int]], object], memory: int) -> None:
        super().__init__()
        self.model, self.value, self.memory = model, value, memory

    def __missing__(self, piece: str) -> object:
        if len(self) >= self.memory:
            self.clear()
        letters = piece if piece.isascii() else "".join([BYTE_LETTERS[b] for b in piece.encode()])
        found = self.value([t.id for t in self.model.tokenize(letters)])
        if len(piece) <= PIECE_CHARS:
            self[piece] = found
        return found


class TextEncoder:
    """Encodes texts as values of their pieces, in order; ``value`` turns a piece's ids into what is remembered.

    Where the vocabulary's splitting is known, plain texts, and plain runs of others, go to its merges piece by piece;
    all other runs go through the library's whole encoder. Both give the same ids. Memory is bounded.
    """

    def __init__(self, tokenizer, value: Callable[[list[int]], object], memory: int = MEMORY) -> None:
        self.tokenizer, self.value, self.memory = tokenizer, value, memory
        setup = json.loads(tokenizer.to_str())
        self.plain = {k: setup[k] for k in _PLAIN_SETUP} == _PLAIN_SETUP and all("<|" in t["content"] for t in setup["added_tokens"])
        self.pieces = Pieces(tokenizer.model, value, memory)
        self.odd: dict[str, object] = {}

    def __call__(self, text: bytes) -> list:
        whole = text.decode("utf-8", "replace")
        if self._is_plain(whole):
            return self._plain(whole)
        runs = [r.decode("utf-8", "replace") for r in text.split()]
        self.learn({r for r in {*runs} if r in self.odd or not self._is_plain(r)})
        out: list = []
        for r in runs:
            out += [self.odd[r]] if r in self.odd else self._plain(r)
        return out

    def learn(self, odd: set[str]) -> None:
        """After this ``self.odd`` has the values of these runs, which aren't plain."""
        new = odd - self.odd.keys()
        if new and len(self.odd) + len(new) > min(self.memory, MEMORY) // 8:
            self.odd, new = {}, odd
        learn = [*new]
        for k in range(0, len(learn), 10_000):
            part = learn[k : k + 10_000]
            for run, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.odd[run] = self.value(e.ids)

    def _is_plain(self, text: str) -> bool:
        return self.plain and _PLAIN.fullmatch(text) is not None and "<|" not in text

    def _plain(self, text: str) -> list:
        return [*map(self.pieces.__getitem__, _PIECES.findall(text.lower()))]


_SHARED: dict[tuple[str, str, int], TextEncoder] = REMEMBERED


def shared_encoder(path: str, kind: str, value: Callable[[object], Callable[[list[int]], object]], memory: int = MEMORY) -> TextEncoder:
    """The encoder that the tasks of one Python worker share, one at a time; what it remembers is bounded."""
    key = (path, kind, memory)
    if key not in _SHARED:
        tokenizer = next((e.tokenizer for (p, *_), e in _SHARED.items() if p == path), None) or load_tokenizer(path)
        _SHARED.clear()
        _SHARED[key] = TextEncoder(tokenizer, value(tokenizer), memory)
    return _SHARED[key]


def ids_encoder(path: str, memory: int = MEMORY) -> TextEncoder:
    """Remembers ids as little-endian unsigned 32-bit integers."""
    return shared_encoder(path, "ids", lambda _: lambda ids: struct.pack(f"<{len(ids)}I", *ids), memory)


def encode_tokens(tokenizer, text: str) -> Tokens:
    e = tokenizer.encode(text, add_special_tokens=False)
    return e.ids, [a for a, _ in e.offsets], [b for _, b in e.offsets]


def shift(tokens: Tokens, by: int) -> Tokens:
    ids, starts, ends = tokens
    return ids, [s + by for s in starts], [e + by for e in ends]


def _settled(a: Tokens, b: Tokens, k: int, j: int) -> bool:
    return a[0][k] == b[0][j] and a[1][k] == b[1][j] and a[2][k] == b[2][j] and a[1][k] < a[2][k]


#: Equal tokens in a row that both sides have to share before they are joined there.
AGREE = 4


def _meet(a: Tokens, b: Tokens, low: int, high: int, last: bool) -> tuple[int, int] | None:
    """Places in a and b behind (``last``: the last) ``AGREE`` equal tokens in a row that lie within low..high."""
    where = {(s, e): k for k, (s, e) in enumerate(zip(a[1], a[2]))}
    places = range(len(b[0]) - AGREE, -1, -1) if last else range(len(b[0]) - AGREE + 1)
    for j in places:
        k = where.get((b[1][j], b[2][j]))
        if k is None or k + AGREE > len(a[0]) or b[1][j] < low or b[2][j + AGREE - 1] > high:
            continue
        if all(_settled(a, b, k + x, j + x) for x in range(AGREE)):
            return k, j
    return None


def join_tokens(text: str, left: Tokens, right: Tokens, cut: int, encode: Callable[[str], Tokens], window: int = WINDOW) -> Tokens:
    """Tokens of ``text`` from those of ``text[:cut]`` and ``text[cut:]`` (whose places count from the text's start)."""
    while True:
        a, b = max(0, cut - window), min(len(text), cut + window)
        middle = shift(encode(text[a:b]), a)
        whole_left, whole_right = a == 0, b == len(text)
        edge = max(1, window // 8)  # tokens at a window's own edges are not trusted
        at_left = (0, 0) if whole_left else _meet(left, middle, a + edge, cut - 1, last=False)
        at_right = (len(right[0]), len(middle[0])) if whole_right else _meet(right, middle, cut + 1, b - edge, last=True)
        if at_left and at_right and at_left[1] <= at_right[1]:
            return tuple(x[: at_left[0]] + m[at_left[1] : at_right[1]] + y[at_right[0] :] for x, m, y in zip(left, middle, right))  # type: ignore[return-value]
        if whole_left and whole_right:
            return middle
        window *= 2


def encode_tree(text: str, encode: Callable[[str], Tokens], part_chars: int = PART_CHARS, window: int = WINDOW) -> Tokens:
    """Encoding of one text by halves, in this process (Spark encodes the parts of ``encode_texts`` in parallel)."""
    if len(text) <= part_chars:
        return encode(text)
    cut = len(text) // 2
    right = shift(encode_tree(text[cut:], encode, part_chars, window), cut)
    return join_tokens(text, encode_tree(text[:cut], encode, part_chars, window), right, cut, encode, window)


_EDGE = re.compile(r"[\x20\x09-\x0D]")


def split_edges(part: str) -> tuple[str, str, str]:
    """The open run at the start, what lies between, and the open run at the end; a part of one run is all start."""
    first = _EDGE.search(part)
    if first is None:
        return part, "", ""
    tail = len(part) - len(re.split(r"[\x20\x09-\x0D]", part)[-1]) if not _EDGE.match(part[-1]) else len(part)
    return part[: first.start()], part[first.start() : tail], part[tail:]


def cut_points(length: int, part_chars: int) -> list[int]:
    """Cuts of a tree of halves, ascending, without the text's ends."""
    todo, cuts = [(0, length)], []
    while todo:
        a, b = todo.pop()
        if b - a > part_chars:
            m = a + (b - a) // 2
            cuts.append(m)
            todo += [(a, m), (m, b)]
    return sorted(cuts)


def _parts(batches: Iterable[pa.RecordBatch], part_chars: int) -> Iterator[pa.RecordBatch]:
    for (docs, keys), texts in text_batches(batches, ["doc_id", "row_key"], remember=True):
        for doc, key, raw in zip(docs, keys, texts):
            text = raw.decode()
            cuts = [0, *cut_points(len(text), part_chars), len(text)]
            n = len(cuts) - 1
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc] * n, pa.int64()), "row_key": pa.array([key] * n, pa.int64()), "part": pa.array(range(n), pa.int32()), "text": pa.array([text[a:b] for a, b in zip(cuts, cuts[1:])], pa.string())})


def encode_part(part: str, runs: TextEncoder, encode: Callable[[str], Tokens]) -> dict:
    """Ids of the closed middle of a part (little-endian unsigned 32-bit), and the tokens of its open runs."""
    head, middle, tail = split_edges(part)
    h, t = encode(head), encode(tail)
    return {"ids": b"".join(runs(middle.encode())), "closed": bool(middle), "head": head, "head_ids": h[0], "head_starts": h[1], "head_ends": h[2], "tail": tail, "tail_ids": t[0], "tail_starts": t[1], "tail_ends": t[2]}


def merge_parts(a: dict, b: dict, encode: Callable[[str], Tokens]) -> dict:
    """One level of the tree: two neighbouring parts become one; only the runs that meet at the joint change."""
    get = lambda p, side: (list(p[f"{side}_ids"]), list(p[f"{side}_starts"]), list(p[f"{side}_ends"]))
    side = "tail" if a["closed"] else "head"
    text, cut = a[side] + b["head"], len(a[side])
    if not cut:
        joint = get(b, "head")
    elif not b["head"]:
        joint = get(a, side)
    else:
        joint = join_tokens(text, get(a, side), shift(get(b, "head"), cut), cut, encode)
    put = lambda side, text, tokens: {side: text, f"{side}_ids": tokens[0], f"{side}_starts": tokens[1], f"{side}_ends": tokens[2]}
    none = put("tail", "", ([], [], []))
    if not a["closed"]:
        rest = {k: v for k, v in b.items() if k.startswith("tail")} if b["closed"] else none
        return {"ids": b["ids"], "closed": b["closed"]} | put("head", text, joint) | rest
    head = {k: v for k, v in a.items() if k.startswith("head")}
    if not b["closed"]:
        return {"ids": a["ids"], "closed": True} | head | put("tail", text, joint)
    ids = a["ids"] + np.asarray(joint[0], dtype="<u4").tobytes() + b["ids"]
    return {"ids": ids, "closed": True} | head | {k: v for k, v in b.items() if k.startswith("tail")}


def finish(part: dict) -> bytes:
    u4 = lambda x: np.asarray(list(x), dtype="<u4").tobytes()
    return u4(part["head_ids"]) + part["ids"] + u4(part["tail_ids"])


PART_SCHEMA = "doc_id long, row_key long, part int, ids binary, closed boolean, head string, head_ids array<int>, head_starts array<int>, head_ends array<int>, tail string, tail_ids array<int>, tail_starts array<int>, tail_ends array<int>"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
PART_ARROW = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in PART_SCHEMA.split(", "))])


def encode_long(docs: DataFrame, tokenizer_path: str, part_chars: int = PART_CHARS, columns: str = "ids binary", values: Callable[[object, bytes], dict] | None = None) -> DataFrame:
    """Rows (doc_id, row_key, ids) of texts that are cut into parts: parts are encoded in parallel, joints merged by document.

    ``values`` makes other ``columns`` of a tokenizer and a document's ids, in the task that merges them: a task of two Python
    steps would take two Python workers.
    """
    cut = docs.select("doc_id", "row_key", "text").mapInArrow(lambda it: _parts(it, part_chars), "doc_id long, row_key long, part int, text string")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = ids_encoder(tokenizer_path)
        for keys, texts in text_batches(batches, ["doc_id", "row_key", "part"], remember=True):
            rows = [encode_part(text.decode(), runs, lambda s: encode_tokens(runs.tokenizer, s)) for text in texts]
            yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "row_key", "part"), keys)) | {c: [r[c] for r in rows] for c in rows[0]}, schema=PART_ARROW)

    def merge(_key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tokenizer = ids_encoder(tokenizer_path).tokenizer
        level = [r for _, r in sorted(group.drop_duplicates("part").set_index("part").to_dict("index").items())]
        while len(level) > 1:
            level = [merge_parts(*level[k : k + 2], lambda s: encode_tokens(tokenizer, s)) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        copies = int((group["part"] == 0).sum())
        doc, key, ids = group["doc_id"].astype("Int64").iloc[0], group["row_key"].iloc[0], finish(level[0])
        own = {"ids": ids} if values is None else values(tokenizer, ids)
        return pd.DataFrame({"doc_id": pd.array([doc] * copies, "Int64"), "row_key": [key] * copies} | {k: [v] * copies for k, v in own.items()})

    parts = cut.repartition("doc_id", "row_key", "part").mapInArrow(encode, PART_SCHEMA)
    return parts.groupBy("doc_id", "row_key").applyInPandas(merge, f"doc_id long, row_key long, {columns}")


def encode_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """Token ids of every whole text: rows (doc_id, ids), ids as little-endian unsigned 32-bit integers.

    A row per row of ``docs``, repeated rows included. Null and empty texts have no ids. Only the id and text
    columns are read.
    """
    source = id_and_text(docs, id_col, text_col).withColumn("row_key", row_key())
    is_long = F.coalesce(F.length("text") > part_chars, F.lit(False))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = ids_encoder(tokenizer_path)
        for (ids,), texts in text_batches(batches, ["doc_id"], remember=True):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "ids": pa.array([b"".join(runs(t)) for t in texts], pa.binary())})

    short = source.where(~is_long).select("doc_id", "text").mapInArrow(encode, "doc_id long, ids binary")
    return short.unionByName(encode_long(source.where(is_long), tokenizer_path, part_chars).drop("row_key"))


class Digest:
    """Of a piece: how many ids, the ids in decimal, and the decoded text, for a tokenizer without a decoder."""

    def __init__(self, tokenizer) -> None:
        self.tokens = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
        self.decimals = [str(i) for i in range(len(self.tokens))]

    def by_piece(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        return len(ids), " ".join([self.decimals[i] for i in ids]).encode(), " ".join([self.tokens[i] for i in ids]).encode()


def encode_and_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """Encode and decode every whole text; rows (doc_id, n_tokens, ids_sha256, decoded_sha256), one per row of ``docs``.

    Null and empty texts have no tokens; their digests are those of the empty string.
    """
    source = id_and_text(docs, id_col, text_col).withColumn("row_key", row_key())
    is_long = F.coalesce(F.length("text") > part_chars, F.lit(False))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def rows(ids: list, counts: list[int], digests: list[str], decoded: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": digests, "decoded_sha256": decoded}, schema=pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    def sha(x: bytes) -> str:
        return hashlib.sha256(x).hexdigest()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared_encoder(tokenizer_path, "digest", lambda tokenizer: Digest(tokenizer).by_piece)
        for (ids,), texts in text_batches(batches, ["doc_id"], remember=True):
            counts, digests, decoded = [], [], []
            for text in texts:
                got = [g for g in runs(text) if g[0]]
                counts.append(sum([g[0] for g in got]))
                digests.append(sha(b" ".join([g[1] for g in got])))
                decoded.append(sha(b" ".join([g[2] for g in got])))
            yield rows(ids, counts, digests, decoded)

    def encode_whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared_encoder(tokenizer_path, "list", lambda _: lambda ids: ids)
        for (ids,), texts in text_batches(batches, ["doc_id"], remember=True):
            all_ids = [[i for piece in runs(t) for i in piece] for t in texts]
            yield rows(ids, [*map(len, all_ids)], [sha(" ".join(map(str, i)).encode()) for i in all_ids], [sha(runs.tokenizer.decode(i, skip_special_tokens=False).encode()) for i in all_ids])

    def of_long(tokenizer, raw: bytes) -> dict:
        ids = np.frombuffer(raw, dtype="<u4").tolist()
        return {"n_tokens": len(ids), "ids_sha256": sha(" ".join(map(str, ids)).encode()), "decoded_sha256": sha(tokenizer.decode(ids, skip_special_tokens=False).encode())}

    # Without a decoder, decode() writes tokens one by one with a space between them, and so can be done by pieces.
    by_piece = load_tokenizer(tokenizer_path).decoder is None
    short = source.where(~is_long).select("doc_id", "text").mapInArrow(encode if by_piece else encode_whole, schema)
    long = encode_long(source.where(is_long), tokenizer_path, part_chars, "n_tokens long, ids_sha256 string, decoded_sha256 string", of_long)
    return short.unionByName(long.drop("row_key"))
