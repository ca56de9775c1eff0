"""Token-id files: blocks of ids under an adaptive context-mixing range coder.

A file is a Parquet table, so that Spark's commit protocol makes it whole or absent on any store and readers split it
anywhere. A row is a chunk: the ids of some whole documents, in blocks of BLOCK_IDS ids. Every block is coded from a
fresh state, has its own checksum and can be read with no other block of the chunk; what it needs beside its own bytes
is the chunk's table, which has a checksum too. A manifest counts chunks, ids and documents of every part, so that a
part that got lost is noticed.

Three predictions of the next id drive the coder. Order 1 starts from the chunk's table: for each frequent id a row of
shares of those that often follow it, and one share for all others. Order 2 (what followed the last two ids before in the
block) is mixed into the row with a weight that adapts to how order 2 did in the same situation: how often in a row it
has held here. Ids that the row does not have are coded by order 0 of such ids: classes of ids, neighbours in the table,
are counted as the block goes; within a class order 0 has the table's shares. The blocks of many chunks are coded in
step as lanes of numpy arrays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, materialize, text_batches
from .pieces import batch_encoder

BLOCK_IDS = 2048
#: Ids after which a chunk ends, at a document's end.
CHUNK_IDS = 1 << 21
#: Lanes that are coded in step at most.
LANES = 4096
#: Lanes that are turned from rows to columns at once.
TILE = 32
#: Rows of order 1 have shares of 2**-ROW_BITS; a chunk has fewer than 2**ROWS of them.
ROW_BITS, ROWS = 10, 13
#: An id has a row if ids of its row follow it so many times, and is in a row if it follows that often.
ROW_LEAST, PAIR_LEAST = 64, 4
#: Classes of ids of order 0, as a power of two, and the scale of the shares within one.
CLASS_BITS, SHARE_BITS = 4, 14
CLASSES = 1 << CLASS_BITS
#: Counts of a class at a block's start, what an id adds, and ids between two updates of the counts.
CLASS_START, CLASS_STEP, CLASS_EVERY = 32, 24, 32
#: Scale of order 2's weights; their precision while they adapt, their rate, and where they start: without a prediction,
#: and with one that has held 0, 1, 2 or more times in a row.
WEIGHT_BITS, FINE_BITS, RATE = 8, 16, 5
WEIGHT_START = (0.0, 0.15, 0.5, 0.7, 0.85)
#: Slots of the order-2 table of a lane, as a power of two.
SLOT_BITS = 11
END_ID = 2

#: The coder's state has 48 bits; when its range is below 2**TOP, the top 16 bits are put out. A distribution has fewer than
#: 2**31 parts.
STATE, WORD = 48, 16
TOP = STATE - WORD
MASK = (1 << STATE) - 1
LOW = (1 << TOP) - 1


class RangeEncoder:
    """Range encoder of a row of lanes. Words of all lanes go to one log in the order in which they are settled; a carry stays
    in the word that it came with until the end."""

    def __init__(self, lanes: int) -> None:
        self.low = np.zeros(lanes, dtype=np.int64)
        self.range = np.full(lanes, MASK, dtype=np.int64)
        self.log: list[tuple[np.ndarray, np.ndarray]] = []

    def narrow(self, lanes: slice | np.ndarray, step: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        """What comes next in ``lanes`` has the parts ``start .. start + width`` of those of size ``step`` that their range is cut into."""
        low, rng = self.low[lanes] + step * start, step * width
        ready = np.flatnonzero(rng <= LOW)
        while len(ready):
            out, more = low.take(ready), rng.take(ready) << WORD
            self.log.append(((ready if isinstance(lanes, slice) else lanes.take(ready)).astype(np.uint16), (out >> TOP).astype(np.uint32)))
            low[ready], rng[ready] = (out & LOW) << WORD, more
            ready = ready[more <= LOW]
        self.low[lanes], self.range[lanes] = low, rng

    def finish(self) -> list[bytes]:
        n = len(self.low)
        for _ in range(STATE // WORD):
            self.log.append((np.arange(n, dtype=np.uint16), (self.low >> TOP).astype(np.uint32)))
            self.low = (self.low & LOW) << WORD
        lane, words = (np.concatenate(x) for x in zip(*self.log))
        words = words[np.argsort(lane, kind="stable")]
        # a word above 16 bits carries into the one before, which is the same lane's: no lane's first word carries
        while len(over := np.flatnonzero(words >> WORD)):
            words[over] &= (1 << WORD) - 1
            words[over - 1] += 1
        ends = np.cumsum(np.bincount(lane, minlength=n)).tolist()
        words = words.astype("<u2")
        return [words[x:y].tobytes() for x, y in zip([0, *ends], ends)]


class RangeDecoder:
    """Range decoder of a row of lanes; ``code`` is counted from the start of the range."""

    def __init__(self, payloads: list[bytes]) -> None:
        self.lanes, sizes = len(payloads), np.array([len(p) // 2 for p in payloads])
        # lanes go on about alike, so that words of one place lie together; a damaged block may ask for more than there are
        self.last = max(int(sizes.max()), STATE // WORD)
        self.words = np.zeros((self.last + 1, self.lanes), dtype=np.uint16)
        for first in range(0, self.lanes, TILE):
            tile = np.zeros((min(TILE, self.lanes - first), self.last + 1), dtype=np.uint16)
            for row, p in zip(tile, payloads[first : first + TILE]):
                row[: len(p) // 2] = np.frombuffer(p, dtype="<u2", count=len(p) // 2)
            self.words[:, first : first + TILE] = tile.T
        self.code = np.zeros(self.lanes, dtype=np.int64)
        for k in range(STATE // WORD):
            self.code = self.code << WORD | self.words[k]
        self.words = self.words.ravel()
        self.at = np.arange(self.lanes) + STATE // WORD * self.lanes
        self.range = np.full(self.lanes, MASK, dtype=np.int64)

    def narrow(self, lanes: slice | np.ndarray, step: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        code, rng = self.code[lanes] - step * start, step * width
        ready = np.flatnonzero(rng <= LOW)
        while len(ready):
            lane = ready if isinstance(lanes, slice) else lanes.take(ready)
            # the range of a damaged block may be empty
            at, more = self.at.take(lane), np.maximum(rng.take(ready), 1) << WORD
            code[ready] = (code.take(ready) << WORD | self.words.take(at, mode="clip")) & MASK
            rng[ready] = more
            self.at[lane] = at + self.lanes
            ready = ready[more <= LOW]
        self.code[lanes], self.range[lanes] = code, rng


class Table:
    """Order 0 of a chunk, in classes: symbol k + 1 stands for the k-th id; shares within a class sum to 2**SHARE_BITS.

    ``packed`` has the class, the start of the share and the share of each symbol in one number, ``slots`` the symbol at
    each place of each class.
    """

    def __init__(self, counts: np.ndarray) -> None:
        n = len(counts)
        mass = np.cumsum(counts) - counts
        # classes of equal mass, and of not too many ids
        by_mass, by_number = mass * (CLASSES // 2) // max(counts.sum(), 1), np.arange(n) * (CLASSES // 2) // max(n, 1)
        cls = by_mass + by_number
        self.packed = np.zeros(n + 1, dtype=np.int64)
        if not n:
            self.slots = np.zeros(CLASSES << SHARE_BITS, dtype=np.uint16)
            return
        edges = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
        members, total = np.diff(np.append(edges, n)), np.add.reduceat(counts, edges)
        if members.max() > 1 << SHARE_BITS:
            raise ValueError("a chunk has too many distinct ids; make CHUNK_IDS smaller")
        share = _shares(counts, edges, members, total, 1 << SHARE_BITS)
        ends = np.cumsum(share)
        self.packed[1:] = cls << (2 * SHARE_BITS + 1) | (ends - share) % (1 << SHARE_BITS) << (SHARE_BITS + 1) | share
        self.slots = np.zeros((CLASSES, 1 << SHARE_BITS), dtype=np.uint16)
        self.slots[cls[edges]] = np.repeat(np.arange(1, n + 1), share).reshape(len(edges), -1)
        self.slots = self.slots.ravel()


def _shares(counts: np.ndarray, edges: np.ndarray, members: np.ndarray, total: np.ndarray, whole: int) -> np.ndarray:
    """Whole shares, of at least 1, of the members of every group; a group's first member has what is left over."""
    share = 1 + counts * np.repeat(whole - members, members) // np.repeat(total, members)
    share[edges] += whole - np.add.reduceat(share, edges)
    return share


class Rows:
    """Order 1 of a chunk. Row 0 belongs to ids without a row, and has the share of all other ids alone.

    Entries are numbered through all rows. The first of a row has symbol 0: an id that the row does not have. ``packed``
    has an entry's symbol, the start of its share and its share in one number, ``row`` the row of each symbol, ``slots``
    the place in the row of the entry at each share of each row.
    """

    def __init__(self, symbols: int, head: np.ndarray, members: np.ndarray, symbol: np.ndarray, share: np.ndarray) -> None:
        """Rows of the symbols ``head`` with so many ``members`` (the first entry included), whose symbols and shares follow."""
        whole = 1 << ROW_BITS
        self.row = np.zeros(symbols + 1, dtype=np.int64)
        self.row[head] = np.arange(1, len(head) + 1)
        members = np.append(1, members)
        self.first = np.cumsum(members) - members
        symbol, share = np.append(0, symbol), np.append(whole, share)
        start = np.cumsum(share) - share - np.repeat(np.arange(len(members)) * whole, members)
        self.packed = symbol << (2 * ROW_BITS + 1) | start << (ROW_BITS + 1) | share
        self.of = np.repeat(np.arange(len(members)), members)
        self.slots = np.repeat(np.arange(len(symbol)) - self.first[self.of], share).astype(np.uint16)


def _order1(symbols: np.ndarray, offset: np.ndarray, distinct: int) -> tuple[list[np.ndarray], np.ndarray]:
    """What Rows is made of for a chunk, and the entry of every id; ``offset`` are the places where blocks start."""
    # pairs of an id before and an id, sorted together with their places; in place, as a chunk's arrays are large
    key = np.zeros(len(symbols), dtype=np.int64)
    key[1:] = symbols[:-1]
    key[offset] = 0
    key <<= 16
    key |= symbols
    key <<= 31
    key |= np.arange(len(symbols), dtype=np.int32)
    key.sort()
    order = (key & ((1 << 31) - 1)).astype(np.int32)
    key >>= 31
    edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    pair, count = key[edges], np.diff(np.append(edges, len(key)))
    head = pair >> 16
    follows = np.bincount(head, count, minlength=distinct + 1).astype(np.int64)
    often = (count >= PAIR_LEAST) & (count * 1000 >= follows[head]) & (head > 0)
    kept = np.bincount(head[often], count[often], minlength=distinct + 1).astype(np.int64)
    heads = np.flatnonzero(kept >= max(ROW_LEAST, 1 + (len(symbols) >> ROWS)))
    number = np.zeros(distinct + 1, dtype=np.int64)
    number[heads] = np.arange(1, len(heads) + 1)
    often &= number[head] > 0
    members = 1 + np.bincount(number[head[often]], minlength=len(heads) + 1)[1:]
    first = np.cumsum(members) - members
    # the first entry of a row, then those of its pairs
    symbol, counts = np.zeros(members.sum(), dtype=np.int64), np.zeros(members.sum(), dtype=np.int64)
    place = np.arange(often.sum()) + number[head[often]]
    symbol[place], counts[place] = pair[often] & 0xFFFF, count[often]
    counts[first] = follows[heads] - kept[heads]
    share = _shares(counts, first, members, follows[heads], 1 << ROW_BITS) if len(heads) else counts
    # row 0 has one entry, so that entries of other rows are one further
    entry = np.where(number[head] > 0, np.append(0, 1 + first)[number[head]], 0)
    entry[often] = place + 1
    entries = np.empty(len(symbols), dtype=np.int32)
    entries[order] = np.repeat(entry.astype(np.int32), count)
    return [heads, members, symbol, share], entries


class Model:
    """Adaptive state of all lanes: predictions of order 2 and their weights by situation, counts of order 0's classes."""

    def __init__(self, lanes: int, tables: list[Table], rows: list[Rows], chunk: np.ndarray) -> None:
        used, own = np.unique(chunk, return_inverse=True)
        starts = lambda sizes: np.cumsum([0, *sizes])[:-1]
        tables, rows = [tables[u] for u in used], [rows[u] for u in used]
        self.base = starts([len(t.packed) for t in tables])[own]
        self.packed0 = np.concatenate([t.packed for t in tables])
        self.symbol_base = starts([len(r.row) for r in rows])[own]
        first_row, first_entry = starts([len(r.first) for r in rows]), starts([len(r.of) for r in rows])
        self.entry_base = first_entry[own]
        self.row = np.concatenate([r.row + n for r, n in zip(rows, first_row)])
        # behind the entries of all rows is one of no row: what order 2 expects where it knows nothing
        self.of = np.append(np.concatenate([r.of + n for r, n in zip(rows, first_row)]), -1)
        self.first = np.concatenate([r.first + n for r, n in zip(rows, first_entry)])
        self.packed = np.append(np.concatenate([r.packed for r in rows]), 0)
        self.all = (tables, rows, own)
        self.slot_base = np.arange(lanes, dtype=np.int64) << SLOT_BITS
        self.class_base = np.arange(lanes, dtype=np.int64) << CLASS_BITS
        self.situations = np.arange(lanes, dtype=np.int64) * len(WEIGHT_START)
        self.fine = np.tile((np.array(WEIGHT_START) * (1 << FINE_BITS)).astype(np.int64), lanes)
        self.after = np.full(lanes << SLOT_BITS, len(self.of) - 1 << 2, dtype=np.int32)
        self.prev, self.prev2 = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
        self.counts = np.full((lanes, CLASSES), CLASS_START, dtype=np.int64)
        self.waiting: list[np.ndarray] = []
        self._sum_up()

    def _sum_up(self) -> None:
        """``sums`` has the counts of all classes before, and ``both`` that and the class's own in one number."""
        ends = np.cumsum(self.counts, axis=1)
        self.total = ends[:, -1].copy()
        self.sums = (ends - self.counts).ravel()
        self.both = self.sums << 20 | self.counts.ravel()

    def predict(self, a: int) -> np.ndarray:
        """Row of order 1, entry of order 2 in it, where that starts, and the weights of the first a lanes; returns the packed entries."""
        prev = self.prev[:a]
        self.here = self.row.take(self.symbol_base[:a] + prev)
        self.slot = self.slot_base[:a] + (((self.prev2[:a] * 40503 + prev) * 2654435761 >> 14) & ((1 << SLOT_BITS) - 1))
        found = self.after.take(self.slot).astype(np.int64)
        self.expected = found >> 2
        self.have = self.of.take(self.expected) == self.here
        self.held = ((found & 3) + 1) * self.have
        self.situation = self.situations[:a] + self.held
        self.f = self.fine.take(self.situation)
        weight = self.f >> (FINE_BITS - WEIGHT_BITS)
        self.w1 = (1 << WEIGHT_BITS) - weight
        self.mass = weight << ROW_BITS
        packed = self.packed.take(self.expected)
        self.at = self.w1 * ((packed >> (ROW_BITS + 1)) & ((1 << ROW_BITS) - 1))
        return packed

    def parts(self, entry: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of entries (0 for order 0), and their start and width in the mix."""
        packed = self.packed.take(entry)
        start = self.w1 * ((packed >> (ROW_BITS + 1)) & ((1 << ROW_BITS) - 1))
        width = self.w1 * (packed & ((2 << ROW_BITS) - 1)) + self.mass * hit
        return packed >> (2 * ROW_BITS + 1), start + self.mass * (start > self.at), width

    def parts0(self, lanes: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width in order 0 of what its table numbers ``other``; counts it."""
        packed = self.packed0.take(self.base[lanes] + other)
        cls = self.class_base[lanes] + (packed >> (2 * SHARE_BITS + 1))
        self.waiting.append(cls)
        both = self.both.take(cls)
        low, count = both >> 20, both & 0xFFFFF
        return (low << SHARE_BITS) + count * ((packed >> (SHARE_BITS + 1)) & ((1 << SHARE_BITS) - 1)), count * (packed & ((2 << SHARE_BITS) - 1))

    def learn(self, t: int, a: int, symbol: np.ndarray, entry: np.ndarray, hit: np.ndarray) -> None:
        self.fine[self.situation] = self.f + ((hit * ((1 << FINE_BITS) - 1 - (1 << (FINE_BITS - WEIGHT_BITS))) - self.f) >> RATE)
        self.after[self.slot] = entry << 2 | np.minimum(self.held, 3) * hit
        self.prev2[:a] = self.prev[:a]
        self.prev[:a] = symbol
        if t % CLASS_EVERY == CLASS_EVERY - 1 and self.waiting:
            self.counts += CLASS_STEP * np.bincount(np.concatenate(self.waiting), minlength=self.counts.size).reshape(self.counts.shape)
            self.waiting = []
            self._sum_up()


def _lanes(parts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of so many ids as lanes of blocks: the chunk of each, its offset and its length."""
    chunk, offset, length = [], [], []
    for k, n in enumerate(parts):
        at = np.arange(0, n, BLOCK_IDS)
        chunk.append(np.full(len(at), k))
        offset.append(at)
        length.append(np.minimum(BLOCK_IDS, n - at))
    chunk, offset, length = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (chunk, offset, length))
    return chunk, offset, length


def encode_chunks(chunks: list[np.ndarray]) -> list[bytes]:
    """Bytes of each chunk of ids (a vocabulary's: small enough to count by; below 2**16 distinct values)."""
    heads, tables, rows, coded = [], [], [], []
    for ids in chunks:
        counts = np.bincount(ids)
        values = np.flatnonzero(counts)
        if len(values) >= 1 << 16:
            raise ValueError("a chunk has too many distinct ids; make CHUNK_IDS smaller")
        place = np.zeros(len(counts), dtype=np.uint16)
        place[values] = np.arange(1, len(values) + 1)
        symbols = place[ids]
        order1, entries = _order1(symbols, np.arange(0, len(ids), BLOCK_IDS), len(values))
        rows.append(Rows(len(values), *order1))
        # order 0 numbers the ids that a row leaves to it
        left = np.bincount(symbols[(rows[-1].packed >> (2 * ROW_BITS + 1) == 0)[entries]], minlength=len(values) + 1)
        others = np.flatnonzero(left)
        number = np.arange(len(values) + 1)
        number[others] |= np.arange(1, len(others) + 1) << 16
        tables.append(Table(left[others]))
        # entry, number in order 0 and symbol of every id in one number
        coded.append(entries.astype(np.int64))
        coded[-1] <<= 32
        coded[-1] |= number.take(symbols)
        heads.append(_pack([values, others, left[others], *order1]))
    chunk, offset, length = _lanes([len(c) for c in chunks])
    order = np.argsort(-length, kind="stable")
    payloads: list[bytes] = [b""] * len(chunk)
    for k in range(0, len(order), LANES):
        group = order[k : k + LANES]
        for i, payload in zip(group.tolist(), _encode_lanes(coded, tables, rows, chunk[group], offset[group], length[group])):
            payloads[i] = payload
    out = []
    for c, ids in enumerate(chunks):
        own = np.flatnonzero(chunk == c)
        raw = ids.astype("<u4")
        checks = np.array([zlib.crc32(raw[offset[i] : offset[i] + length[i]].tobytes()) for i in own], dtype="<u4")
        sizes = np.array([len(payloads[i]) for i in own], dtype="<u4")
        head = np.array([len(ids), len(heads[c]), len(own)], dtype="<u4").tobytes() + heads[c] + sizes.tobytes() + checks.tobytes()
        out.append(zlib.crc32(head).to_bytes(4, "little") + head + b"".join(payloads[i] for i in own))
    return out


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of small numbers, compressed: of ascending ones the steps are kept, bytes of equal weight lie together."""
    out = []
    for x in arrays:
        steps = np.diff(x, prepend=0).astype("<i4")
        out.append(np.array([len(x)], dtype="<u4").tobytes() + steps.view(np.uint8).reshape(-1, 4).T.tobytes())
    return zlib.compress(b"".join(out), 6)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw, out = zlib.decompress(data), []
    while raw:
        n = int.from_bytes(raw[:4], "little")
        steps = np.ascontiguousarray(np.frombuffer(raw[4 : 4 + 4 * n], dtype=np.uint8).reshape(4, n).T).view("<i4").ravel()
        out.append(np.cumsum(steps, dtype=np.int64))
        raw = raw[4 + 4 * n :]
    return out


def _encode_lanes(coded: list[np.ndarray], tables: list[Table], rows: list[Rows], chunk: np.ndarray, offset: np.ndarray, length: np.ndarray) -> list[bytes]:
    lanes, longest = len(chunk), int(length[0])
    coder, model = RangeEncoder(lanes), Model(lanes, tables, rows, chunk)
    grid = np.empty((longest, lanes), dtype=np.int64)
    for first in range(0, lanes, TILE):  # a row for each step; few lanes at once stay in the cache
        tile = np.zeros((min(TILE, lanes - first), longest), dtype=np.int64)
        for k, row in enumerate(tile, start=first):
            row[: length[k]] = coded[chunk[k]][offset[k] : offset[k] + length[k]]
        grid[:, first : first + TILE] = tile.T
    alive = np.searchsorted(-length, -np.arange(longest), side="left")
    for t in range(longest):
        a = int(alive[t])
        now = grid[t, :a]
        entry = (now >> 32) + model.entry_base[:a]
        model.predict(a)
        hit = entry == model.expected
        symbol, start, width = model.parts(entry, hit)
        coder.narrow(slice(0, a), coder.range[:a] >> (ROW_BITS + WEIGHT_BITS), start, width)
        left = np.flatnonzero(symbol == 0)
        if len(left):
            step = (coder.range[left] >> SHARE_BITS) // model.total[left]
            coder.narrow(left, step, *model.parts0(left, (now[left] >> 16) & 0xFFFF))
        model.learn(t, a, now & 0xFFFF, entry, hit)
    return coder.finish()


class DamagedFile(ValueError):
    """Bytes of a chunk that can't be what was written."""


def decode_chunks(data: list[bytes]) -> list[np.ndarray]:
    """Ids of each chunk; the checksums of its table and of every block are compared."""
    values, others, tables, rows, checks, counts, payloads = [], [], [], [], [], [], []
    for d in data:
        if len(d) < 16:
            raise DamagedFile("a chunk is cut off")
        check, n, v, b = np.frombuffer(d, dtype="<u4", count=4).tolist()
        ends = 16 + v + 8 * b
        if len(d) < ends or zlib.crc32(d[4:ends]) != check or b != -(-n // BLOCK_IDS):
            raise DamagedFile("the table of a chunk is damaged")
        value, other, left, *order1 = _unpack(d[16 : 16 + v])
        values.append(value)
        others.append(np.append(0, other))
        tables.append(Table(left))
        rows.append(Rows(len(value), *order1))
        numbers = np.frombuffer(d[16 + v : ends], dtype="<u4")
        cuts = ends + np.concatenate([[0], np.cumsum(numbers[:b], dtype=np.int64)])
        if cuts[-1] != len(d):
            raise DamagedFile("a chunk is cut off")
        payloads += [d[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
        checks.append(numbers[b:])
        counts.append(n)
    chunk, offset, length = _lanes(counts)
    out = [np.zeros(n, dtype=np.uint32) for n in counts]
    order = np.argsort(-length, kind="stable")
    for k in range(0, len(order), LANES):
        group = order[k : k + LANES]
        grid = _decode_lanes([payloads[i] for i in group], others, tables, rows, chunk[group], length[group])
        for j, i in enumerate(group.tolist()):
            out[chunk[i]][offset[i] : offset[i] + length[i]] = values[chunk[i]][grid[j, : length[i]] - 1]
    for c in range(len(data)):
        for b, i in enumerate(np.flatnonzero(chunk == c)):
            if zlib.crc32(out[c][offset[i] : offset[i] + length[i]].astype("<u4").tobytes()) != checks[c][b]:
                raise DamagedFile(f"block {b} of a chunk is damaged")
    return out


def _decode_lanes(payloads: list[bytes], others: list[np.ndarray], tables: list[Table], rows: list[Rows], chunk: np.ndarray, length: np.ndarray) -> np.ndarray:
    lanes, longest = len(chunk), int(length[0])
    alive = np.searchsorted(-length, -np.arange(longest), side="left")
    coder, model = RangeDecoder(payloads), Model(lanes, tables, rows, chunk)
    tables, rows, own = model.all
    row_slots, slots0 = np.concatenate([r.slots for r in rows]), np.concatenate([t.slots for t in tables])
    slot0_base = own << (CLASS_BITS + SHARE_BITS)
    symbol0 = np.concatenate([others[u] for u in np.unique(chunk)])
    grid = np.zeros((longest, lanes), dtype=np.int32)
    for t in range(longest):
        a = int(alive[t])
        packed = model.predict(a)
        end = model.at + model.w1 * (packed & ((2 << ROW_BITS) - 1)) + model.mass
        step = coder.range[:a] >> (ROW_BITS + WEIGHT_BITS)
        value = np.minimum(coder.code[:a] // step, (1 << (ROW_BITS + WEIGHT_BITS)) - 1)
        # what lies beyond the entry of order 2 is order 1, shifted by its mass
        beyond = value >= end
        hit = (value >= model.at) & ~beyond & model.have
        share = np.minimum((value - model.mass * beyond) // model.w1, (1 << ROW_BITS) - 1)
        entry = model.first.take(model.here) + row_slots.take((model.here << ROW_BITS) + share)
        entry = np.where(hit, model.expected, entry)
        symbol, start, width = model.parts(entry, hit)
        coder.narrow(slice(0, a), step, start, width)
        left = np.flatnonzero(symbol == 0)
        if len(left):
            total = model.total[left]
            step = (coder.range[left] >> SHARE_BITS) // total
            value = np.minimum(coder.code[left] // step, (total << SHARE_BITS) - 1)
            part, base = value >> SHARE_BITS, model.class_base[left]
            at = base.copy()
            for k in range(CLASS_BITS - 1, -1, -1):
                at += (model.sums.take(at + (1 << k)) <= part) << k
            both = model.both.take(at)
            share = np.minimum((value - (both >> 20 << SHARE_BITS)) // (both & 0xFFFFF), (1 << SHARE_BITS) - 1)
            other = slots0.take(slot0_base[left] + (at - base << SHARE_BITS) + share).astype(np.int64)
            coder.narrow(left, step, *model.parts0(left, other))
            symbol[left] = symbol0.take(model.base[left] + other)
        model.learn(t, a, symbol, entry, hit)
        grid[t, :a] = symbol
    return np.ascontiguousarray(grid.T)


FILE_SCHEMA = "part int, chunk int, part_start long, doc_ids array<long>, doc_sizes array<int>, coded binary"


def write_ids(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the ids in ascending order of ids; returns the file's rows.

    Null and empty texts have the end id alone. A null id comes first; rows that share an id are ordered by text.
    ``part`` ascends with the ids, ``part_start`` counts the ids of the part's chunks before.
    """
    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def chunk_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[list]:
        encode = batch_encoder(tokenizer_path, end_id)
        docs_: list = []
        held, before, number = 0, 0, 0
        for (ids, parts), texts in text_batches(batches, ["doc_id", "part"], remember=True):
            tokens, sizes = encode(texts)
            for i, part, coded in zip(ids, parts, np.split(tokens, np.cumsum(sizes)[:-1])):
                docs_.append((i, coded))
                held += len(coded)
                if held >= CHUNK_IDS:
                    yield [part, number, before, docs_]
                    docs_, before, held, number = [], before + held, 0, number + 1
        if docs_:
            yield [part, number, before, docs_]

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list] = []
        for row in chunk_rows(batches):
            waiting.append(row)
            if len(waiting) * CHUNK_IDS >= LANES * BLOCK_IDS:
                yield _coded(waiting)
                waiting = []
        if waiting:
            yield _coded(waiting)

    return materialize(ordered.mapInArrow(write, FILE_SCHEMA), "token-ids")


def _coded(rows: list[list]) -> pa.RecordBatch:
    chunks = [np.concatenate([c for _, c in docs]) for *_, docs in rows]
    return pa.RecordBatch.from_pydict({
        "part": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([r[1] for r in rows], pa.int32()), "part_start": pa.array([r[2] for r in rows], pa.int64()),
        "doc_ids": pa.array([[i for i, _ in r[3]] for r in rows], pa.list_(pa.int64())), "doc_sizes": pa.array([[len(c) for _, c in r[3]] for r in rows], pa.list_(pa.int32())),
        "coded": pa.array(encode_chunks(chunks), pa.binary()),
    })


def parts_of(files: DataFrame) -> DataFrame:
    """Rows (part, chunks, ids, docs) of a file."""
    ids = F.aggregate("doc_sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    return files.groupBy("part").agg(F.count("*").alias("chunks"), F.sum(ids).alias("ids"), F.sum(F.size("doc_sizes")).cast("long").alias("docs"))


def write_manifest(files: DataFrame) -> DataFrame:
    """What was written, as a table of its own beside the file: a row for each part."""
    return materialize(parts_of(files), "token-manifest")


def read_ids(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of a written file; ids as little-endian unsigned 32-bit integers.

    With a manifest the parts found are compared with those written; a file that has lost one, or a chunk, is an error.
    """
    found = parts_of(files)
    if manifest is not None:
        same = F.struct("a.chunks", "a.ids", "a.docs").eqNullSafe(F.struct("b.chunks", "b.ids", "b.docs"))
        wrong = manifest.alias("a").join(found.alias("b"), "part", "full_outer").where(~same).select("part").take(1)
        if wrong:
            raise DamagedFile(f"part {wrong[0]['part']} isn't what was written")
    starts = found.select(F.col("part").alias("of_part"), (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))  # a row for each part

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []
        for batch in batches:
            for k in range(batch.num_rows):
                waiting += batch.slice(k, 1).to_pylist()
                if len(waiting) * CHUNK_IDS >= LANES * BLOCK_IDS:
                    yield from documents(waiting)
                    waiting = []
        if waiting:
            yield from documents(waiting)

    def documents(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        for row, ids in zip(rows, decode_chunks([r["coded"] for r in rows])):
            n = np.array(row["doc_sizes"], dtype=np.int64)
            ends = np.cumsum(n)
            raw = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(row["before"] + row["part_start"] + ends - n, pa.int64()), "n_tokens": pa.array(n, pa.int64()),
                "ids": pa.array([raw[4 * (e - m) : 4 * e] for e, m in zip(ends.tolist(), n.tolist())], pa.binary()),
            })

    placed = files.join(F.broadcast(starts), F.col("part") == F.col("of_part")).drop("of_part")  # one row for each task that wrote
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def ids_digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    return read_ids(spark.read.schema(FILE_SCHEMA).parquet(path))

