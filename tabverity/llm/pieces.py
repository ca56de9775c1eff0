"""Ids of many plain texts at once: what ``bpe.TextEncoder`` does piece by piece, as numpy arrays of a batch's pieces.

A piece of at most 16 bytes is two numbers, and so is compared whole. Pieces that are known have a place in a bounded
table; unknown ones are merged together, a merge of each in a step. Longer pieces, and runs that aren't plain, go through
``TextEncoder``.
"""

from __future__ import annotations

import json

import numpy as np

from .bpe import _PLAIN, BYTE_LETTERS, REMEMBERED, TextEncoder, ids_encoder

#: Slots of the table of pieces, as a power of two, and pieces in it at most (about 40 MB with their ids).
SLOT_BITS, MEMORY = 20, 600_000
#: Pieces that are looked up at once; the table has room for as many more.
AT_ONCE = 1 << 18
#: Pieces that are merged at once.
MERGED = 1 << 14
#: Bytes of a piece that the table holds, 2**PLACE_BITS.
PLACE_BITS = 4
LONGEST = 1 << PLACE_BITS
#: Kinds of bytes; those from DIGIT on stand alone. ODD ones are in no plain text.
SPACE, LETTER, OTHER, DIGIT, END, ODD = range(6)
#: Keep the first k bytes of eight.
LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Settings of a model whose merges are plain: the lowest rank first, of equal ones the leftmost.
_PLAIN_MODEL = {"type": ("BPE",), "dropout": (None,), "continuing_subword_prefix": (None, ""), "byte_fallback": (False, None), "ignore_merges": (False, None)}


def _kinds() -> bytes:
    kinds = [LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else OTHER for b in range(128)] + [LETTER] * 64 + [ODD] * 64
    for b in range(128):
        if b in b" \t\n\r\v\f":
            kinds[b] = SPACE
        elif not _PLAIN.fullmatch(chr(b)):
            kinds[b] = ODD
    kinds[0xC3:0xC6] = [LETTER] * 3
    return bytes(kinds)


def _lower() -> np.ndarray:
    """By the two bytes of a plain letter beyond ASCII those of its lower case; 0: no plain letter."""
    table = np.zeros(1 << 16, dtype=np.uint16)
    for letter in map(chr, range(0xC0, 0x180)):
        if _PLAIN.fullmatch(letter):
            table[int.from_bytes(letter.encode(), "big")] = int.from_bytes(letter.lower().encode(), "big")
    return table


KINDS, LOWER = _kinds(), _lower()


class Places:
    """Numbers of distinct keys of twice 64 bits, from 0 on as they are added; the first half is never 0."""

    def __init__(self, bits: int) -> None:
        self.bits, self.count = bits, 0
        self.first, self.second = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.uint64)
        self.number = np.zeros(1 << bits, dtype=np.int32)

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mixed = (a ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of keys; -1 for unknown ones."""
        slot = self._slot(a, b)
        got = self.first.take(slot)
        same = (got == a) & (self.second.take(slot) == b)
        found = np.where(same, self.number.take(slot), -1)
        going = np.flatnonzero(~same & (got != 0))
        while len(going):
            at = slot[going] = (slot[going] + 1) & ((1 << self.bits) - 1)
            got = self.first.take(at)
            same = (got == a[going]) & (self.second.take(at) == b[going])
            found[going[same]] = self.number[at[same]]
            going = going[~same & (got != 0)]
        return found

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Adds unknown keys, repeated ones once; where those are that got the next numbers, in that order."""
        slot, todo, added = self._slot(a, b), np.arange(len(a), dtype=np.int32), [np.zeros(0, dtype=np.int64)]
        while len(todo):
            at = slot[todo]
            free = self.first.take(at) == 0
            claim, where = todo[free], at[free]
            self.number[where] = claim
            won = self.number.take(where) == claim
            claim, where = claim[won], where[won]
            self.first[where], self.second[where] = a[claim], b[claim]
            self.number[where] = np.arange(self.count, self.count + len(claim))
            self.count += len(claim)
            added.append(claim)
            todo = todo[(self.first.take(at) != a[todo]) | (self.second.take(at) != b[todo])]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return np.concatenate(added)


class Merges:
    """A vocabulary's merges, applied to many short pieces at once."""

    NONE = 1 << 30

    def __init__(self, model: dict) -> None:
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.letters, self.last = np.array([[vocab[x + y] for x in BYTE_LETTERS] for y in ("", suffix)], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, self.made = (np.array(x, dtype=np.int64) for x in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]))
        self.ranks = Places(int(len(pairs) * 2).bit_length())
        key = self._key(left, right)
        # merges are numbered by rank
        added = self.ranks.add(key, np.zeros_like(key))
        if len(added) < len(pairs):
            raise ValueError("a merge is repeated")
        taken = np.flatnonzero(self.ranks.first)
        self.ranks.number[taken] = added[self.ranks.number[taken]]

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left << 32 | right) + 1).astype(np.uint64)

    def _ranks(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Ranks of pairs, and the places of their left halves, in one number."""
        key = self._key(left, right)
        rank = self.ranks.find(key, np.zeros_like(key)).astype(np.int64)
        return np.where(rank < 0, self.NONE, rank << PLACE_BITS | place)

    def __call__(self, letters: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, given as rows of bytes, one after another, and how many each has."""
        rows, width = letters.shape
        letters, each = np.ascontiguousarray(letters.T), np.arange(rows)
        place = np.repeat(np.arange(width), rows).reshape(width, rows)
        alive = place < size
        ids = self.letters.take(letters)
        ids[size - 1, each] = self.last.take(letters[size - 1, each])
        rank = np.full((width, rows), self.NONE, dtype=np.int64)
        k, r = np.nonzero(alive[1:])
        rank[k, r] = self._ranks(ids[k, r], ids[k + 1, r], k)
        # a place's neighbours, as merges leave them
        after, before = place + 1, place - 1
        flat_ids, flat_rank, flat_alive, after, before = (x.ravel() for x in (ids, rank, alive, after, before))
        while True:
            best = rank.min(axis=0)
            row = np.flatnonzero(best < self.NONE)
            if not len(row):
                break
            best = best[row]
            at = best & ((1 << PLACE_BITS) - 1)
            here = at * rows + row
            gone = after.take(here) * rows + row
            flat_ids[here] = self.made.take(best >> PLACE_BITS)
            flat_alive[gone] = False
            flat_rank[gone] = flat_rank[here] = self.NONE
            next_, prev = after.take(gone), before.take(here)
            after[here] = next_
            w, v = np.flatnonzero(next_ < size[row]), np.flatnonzero(prev >= 0)
            right, left = next_[w] * rows + row[w], prev[v] * rows + row[v]
            before[right] = at[w]
            pair = np.append(here[w], left)
            flat_rank[pair] = self._ranks(flat_ids.take(pair), flat_ids.take(np.append(right, here[v])), np.append(at[w], prev[v]))
        return ids.T[alive.T], alive.sum(axis=0)


class BatchEncoder:
    """Ids of texts, each followed by the end id. What it remembers of pieces is bounded."""

    def __init__(self, encoder: TextEncoder, end_id: int, memory: int = MEMORY) -> None:
        self.encoder, self.tokenizer, self.end_id, self.memory = encoder, encoder.tokenizer, end_id, memory
        model = json.loads(encoder.tokenizer.to_str())["model"]
        plain = encoder.plain and all(model.get(k) in v for k, v in _PLAIN_MODEL.items())
        plain = plain and all(x in model["vocab"] and x + (model["end_of_word_suffix"] or "") in model["vocab"] for x in BYTE_LETTERS)
        self.merges = Merges(model) if plain else None
        self._forget()

    def _forget(self) -> None:
        self.places = Places(SLOT_BITS)
        self.start, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.pool, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        # the end of a text is a piece of one byte that is in no plain text
        self.places.add(LEFT[1:2], LEFT[:1])
        self._put(np.array([self.end_id], dtype=np.uint32), np.array([1]))

    def _room(self, ids: np.ndarray) -> None:
        """Ids behind those that are kept."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.append(self.pool[: self.used], np.zeros(self.used + 2 * len(ids), dtype=np.uint32))
        self.pool[self.used : self.used + len(ids)] = ids

    def _put(self, ids: np.ndarray, size: np.ndarray) -> None:
        self._room(ids)
        self.start = np.append(self.start, self.used + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.used += len(ids)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has, the end id included."""
        if self.merges is None:
            end = np.array([self.end_id], dtype="<u4").tobytes()
            each = [b"".join(self.encoder(t)) + end for t in texts]
            return np.frombuffer(b"".join(each), dtype="<u4"), np.array([len(x) // 4 for x in each], dtype=np.int64)
        joined = b"\0".join(texts) + b"\0"
        data, kind, odd = self._bytes(joined, texts)
        bound = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] >= DIGIT))
        if b"'" in joined:
            self._contractions(data, bound)
        odd_start, odd_end = self._odd_runs(kind, bound, odd)
        at = np.flatnonzero(bound)
        size = np.diff(at, append=len(kind))
        kept = kind.take(at) != SPACE
        at, size = at[kept], size[kept]
        # runs that aren't plain are pieces of their own
        is_odd = np.searchsorted(at, odd_start)
        long = np.flatnonzero(size > LONGEST)
        long = long[~np.isin(long, is_odd)] if len(is_odd) else long
        words = np.ndarray(len(data) - 8, dtype="<u8", buffer=data, strides=(1,))
        a, b = words[at] & LEFT.take(np.minimum(size, 8)), np.zeros(len(at), dtype=np.uint64)
        wide = np.flatnonzero(size > 8)
        b[wide] = words[at[wide] + 8] & LEFT.take(np.minimum(size[wide] - 8, 8))
        other = np.append(is_odd, long)
        a[other], b[other] = LEFT[1], 0
        values = dict(zip(is_odd.tolist(), self._odd(joined, odd_start, odd_end)))
        out, counts = [], np.empty(len(at), dtype=np.int64)
        for k in range(0, len(at), AT_ONCE):
            part = slice(k, k + AT_ONCE)
            number = self._numbers(data, at[part], size[part], a[part], b[part])
            start, count = self.start.take(number), self.size.take(number)
            own = np.sort(other[(other >= k) & (other < k + AT_ONCE)])
            if len(own):
                found = [values[x] if x in values else self.encoder.pieces[data[at[x] : at[x] + size[x]].tobytes().decode()] for x in own.tolist()]
                self._room(np.frombuffer(b"".join(found), dtype="<u4"))
                own -= k
                count[own] = [len(v) // 4 for v in found]
                start[own] = self.used + np.cumsum(count[own]) - count[own]
            ends = np.cumsum(count)
            out.append(self.pool.take(np.repeat(start - (ends - count), count) + np.arange(ends[-1])))
            counts[part] = count
        return np.concatenate(out), np.diff(np.cumsum(counts)[kind.take(at) == END], prepend=0)

    def _odd(self, joined: bytes, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        runs = [joined[x:y].decode("utf-8", "replace") for x, y in zip(start.tolist(), end.tolist())]
        self.encoder.learn({*runs})
        return [self.encoder.odd[r] for r in runs]

    def _bytes(self, joined: bytes, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the texts in lower case, with zeros behind them, the kind of each, and where odd ones are."""
        data = np.frombuffer(joined.lower() + bytes(24), dtype=np.uint8).copy()
        kind = np.frombuffer(joined.translate(KINDS), dtype=np.uint8).copy()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        kind[ends] = END
        odd = [np.flatnonzero(kind == ODD)]
        if not joined.isascii():
            lead = np.flatnonzero(data >= 0xC0)
            lower = LOWER.take(data[lead].astype(np.int64) << 8 | data[lead + 1])
            good = lower > 0
            odd.append(lead[~good])
            lead, lower = lead[good], lower[good]
            data[lead], data[lead + 1] = lower >> 8, lower & 0xFF
            behind = np.flatnonzero((data >= 0x80) & (data < 0xC0))
            if len(behind) != len(lead):
                odd.append(behind[~np.isin(behind, lead + 1)])
        if b"<|" in joined:
            odd.append(np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))))
        data[ends] = 0xFF
        return data, kind, np.concatenate(odd)

    @staticmethod
    def _contractions(data: np.ndarray, bound: np.ndarray) -> None:
        at = np.flatnonzero(data == ord("'"))
        at = at[bound[at]]
        x, y = data[at + 1], data[at + 2]
        two = np.isin(x, np.frombuffer(b"stmd", dtype=np.uint8))
        three = np.isin(x.astype(np.int64) << 8 | y, [int.from_bytes(s, "big") for s in (b"re", b"ve", b"ll")])
        for size, which in ((2, two), (3, three)):
            bound[at[which] + 1] = False
            bound[at[which] + size] = True

    @staticmethod
    def _odd_runs(kind: np.ndarray, bound: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs without white space start and end that have odd bytes; nothing bounds pieces within them."""
        if not len(odd):
            return odd, odd
        inside = np.concatenate([[False], (kind != SPACE) & (kind != END)])
        start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        which = np.unique(np.searchsorted(start, odd, side="right") - 1)
        start, end = start[which], end[which]
        step = np.zeros(len(kind) + 1, dtype=np.int8)
        step[start], step[end] = 1, -1
        bound &= np.cumsum(step[:-1], dtype=np.int8) == 0
        bound[start] = True
        return start, end

    def _numbers(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of the pieces, of which unknown ones are learned."""
        number = self.places.find(a, b)
        new = np.flatnonzero(number < 0)
        if not len(new):
            return number
        if self.places.count + len(new) > self.memory:
            self._forget()
            new = np.flatnonzero(self.places.find(a, b) < 0)
        added = new[self.places.add(a[new], b[new])]
        for k in range(0, len(added), MERGED):
            part = added[k : k + MERGED]
            self._put(*self.merges(data[at[part, None] + np.arange(LONGEST)], size[part]))
        return self.places.find(a, b)


def batch_encoder(path: str, end_id: int) -> BatchEncoder:
    """The encoder that the tasks of one Python worker share, one at a time."""
    key = (path, "batch", end_id)
    if key not in REMEMBERED:
        encoder = ids_encoder(path)
        REMEMBERED[key] = BatchEncoder(encoder, end_id)
    return REMEMBERED[key]
