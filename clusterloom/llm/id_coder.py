"""An adaptive context-mixing range coder for token ids, in blocks that are coded side by side.

Each id is coded in one step (or two) from the mix of three predictions. Order 1, the id before, has the frame's counts of
the pairs that occur LISTED times or more; the rest of its probability goes to order 0, the frame's counts of all ids, which
a second step then codes. Order 2, the two ids before, is learnt inside a block: a slot holds what came last and how often it
did, and its weight in the mix is learnt as well, by its share in the probability of what came. Every block starts from the same
fresh state, which the frame's header holds (the ids, the pairs and their counts), and ends in bytes of its own. All
arithmetic is on whole numbers, so every machine decodes alike. One NumPy operation handles a step of all blocks of a frame.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: log2 of the slots of order 2 of a block; pairs of a frame that are listed occur so often.
SLOTS, LISTED = 12, 3
#: The coder's interval has STATE bits; below NARROW it is cut at a boundary, so that bytes get certain. Predictions have up to
#: MOST_BITS bits, and weights WEIGHT more: both fit NARROW.
STATE, NARROW, LEAST_BITS, MOST_BITS, WEIGHT = 56, 1 << 44, 16, 31, 12
#: A slot's count is up to CERTAIN; weights of 65,536 by that count at first, and the largest one.
CERTAIN = 7
_WEIGHTS = np.array([0, 14000, 24000, 32000, 38000, 42000, 46000, 50000], dtype=np.int32)
MOST_WEIGHT = 64000
_LOW = (1 << (STATE - 8)) - 1
#: Decoders look numbers up in a table where order 0 has up to 2^TABLE places.
TABLE = 22


class Damaged(ValueError):
    """Bytes that don't decode to what was coded."""


class _Coder:
    """Range coders of many blocks, one in each lane. data: None to encode, else the lanes' bytes, padded."""

    def __init__(self, lanes: int, data: np.ndarray | None, most: int):
        self.least, self.most = np.zeros(lanes, np.int64), np.full(lanes, (1 << STATE) - 1)
        self.at, self.decoding = np.zeros(lanes, np.int64), data is not None
        if self.decoding:
            self.width, self.flat = data.shape[1], data.ravel()
            self.code = np.zeros(lanes, np.int64)
            for k in range(STATE // 8):
                self.code = self.code << 8 | data[:, k]
            self.at[:] = STATE // 8
        else:
            self.width, self.flat = most, np.zeros(lanes * most, np.uint8)

    def settle(self, where: slice | np.ndarray) -> None:
        """Puts out (or takes in) the bytes that are certain in these lanes."""
        least, most = self.least[where], self.most[where]
        go = np.flatnonzero(((least ^ most) <= _LOW) | (most - least < NARROW))
        if not isinstance(where, slice):
            go = where[go]
        while len(go):
            low, high = self.least[go], self.most[go]
            apart = (low ^ high) > _LOW
            narrow = np.flatnonzero(apart & (high - low < NARROW))
            if len(narrow):  # keep the larger side of the boundary inside
                x, y = low[narrow], high[narrow]
                edge = x | (NARROW - 1)
                left = edge - x >= y - edge
                low[narrow], high[narrow] = np.where(left, x, edge + 1), np.where(left, np.minimum(edge, y), y)
                self.least[go], self.most[go] = low, high
                apart = (low ^ high) > _LOW
            if apart.any():
                same = ~apart
                go, low, high = go[same], low[same], high[same]
            at = self.at[go]
            if self.decoding:
                self.code[go] = (self.code[go] & _LOW) << 8 | self.flat[go * self.width + at]
            else:
                self.flat[go * self.width + at] = high >> (STATE - 8)
            self.at[go] = at + 1
            low, high = (low & _LOW) << 8, (high & _LOW) << 8 | 255
            self.least[go], self.most[go] = low, high
            go = go[((low ^ high) <= _LOW) | (high - low < NARROW)]

    def sought(self, where: slice | np.ndarray, bits: int) -> np.ndarray:
        """Where in a total of 2^bits the code lies."""
        least = self.least[where]
        return np.minimum((self.code[where] - least) // (self.most[where] - least >> bits), (1 << bits) - 1)

    def span(self, where: slice | np.ndarray, begin: np.ndarray, size: np.ndarray, bits: int) -> None:
        """Goes on with that part of a total of 2^bits."""
        least = self.least[where]
        unit = self.most[where] - least >> bits
        least = least + unit * begin
        self.least[where], self.most[where] = least, least + unit * size - 1

    def finish(self) -> list[bytes]:
        """Each lane's bytes; a decoder reads zeros behind them."""
        self.settle(slice(0, len(self.least)))
        lanes = np.arange(len(self.least))
        self.flat[lanes * self.width + self.at] = (self.least >> (STATE - 8)) + 1
        rows = self.flat.reshape(len(lanes), self.width)
        return [rows[i, : self.at[i] + 1].tobytes() for i in lanes.tolist()]


def _scaled(counts: np.ndarray, begins: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(where they begin, sizes) of the counts of each group, of a total of 2^bits or just below; no size is 0."""
    lengths = np.diff(np.append(begins, len(counts)))
    of = np.repeat(np.arange(len(begins)), lengths)
    ends = np.cumsum(counts)
    total = np.add.reduceat(counts, begins)
    before = ends - counts - (ends[begins] - counts[begins])[of]
    room, place = ((1 << bits) - lengths)[of], np.arange(len(counts)) - begins[of]
    # Shares in 2^31 parts first: products stay within 63 bits.
    start = (_share(before, total[of]) * room >> 31) + place
    end = (_share(before + counts, total[of]) * room >> 31) + place + 1
    return start, end - start


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return (part << 31) // whole


class _Frame:
    """The predictions of a frame's header: numbers 0, 1, ... with falling counts, and the listed pairs in order. Entries are
    the listed successors of each number and behind them its rest, which stands for all other ones: symbol -1."""

    def __init__(self, counts: np.ndarray, pairs: np.ndarray, times: np.ndarray):
        n = len(counts)
        self.bits = max(LEAST_BITS, n.bit_length() + 2)
        if self.bits > MOST_BITS:
            raise ValueError("too many distinct ids in a frame")
        self.first, self.sizes = _scaled(counts, np.zeros(1, np.int64), self.bits)
        before = pairs // n
        rest = np.maximum(1, counts - np.bincount(before, times, n).astype(np.int64))
        # A number's rest comes behind its pairs.
        ends = np.searchsorted(before, np.arange(n), "right")
        place = np.arange(len(pairs)) + before
        self.rests = ends + np.arange(n)
        self.symbol, self.owner, weight = np.full(n + len(pairs), -1, np.int64), np.zeros(n + len(pairs), np.int64), np.zeros(n + len(pairs), np.int64)
        self.symbol[place], self.owner[place], weight[place] = pairs % n, before, times
        self.owner[self.rests], weight[self.rests] = np.arange(n), rest
        self.start, self.size = _scaled(weight, np.concatenate([[0], self.rests[:-1] + 1]), self.bits)
        self.places = self.owner << self.bits | self.start
        self.place = place

    def index(self) -> None:
        """Tables for decoding: the number that each place of order 0 has, and for each number four or more equal parts of its total
        an entry, with the last entry that begins no later than each part."""
        self.numbers = None
        if self.bits <= TABLE:
            self.numbers = np.repeat(np.arange(len(self.first), dtype=np.int32), self.sizes)
            self.numbers = np.append(self.numbers, np.full((1 << self.bits) - len(self.numbers), len(self.first) - 1, np.int32))
        own = np.diff(self.rests, prepend=-1)
        self.shift = np.maximum(0, self.bits - 2 - np.frexp(own)[1])
        parts = 1 << self.bits - self.shift
        self.base = np.cumsum(parts) - parts
        self.parts = np.zeros(int(parts.sum()) + 1, np.int64)
        shift = self.shift[self.owner]
        # Entries are in order: of those in one place the last one counts.
        self.parts[self.base[self.owner] + (self.start + (1 << shift) - 1 >> shift)] = np.arange(len(self.owner))
        np.maximum.accumulate(self.parts, out=self.parts)
        self.ends = np.append(self.places[1:], np.int64(1) << 62)

    def entry_at(self, now: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The entry of each number that holds that place of its total."""
        e = self.parts.take(self.base.take(now) + (v >> self.shift.take(now)))
        v = (now << self.bits) + v
        e += self.ends.take(e) <= v
        more = np.flatnonzero(self.ends.take(e) <= v)
        if len(more):
            e[more] = np.searchsorted(self.places, v[more], "right") - 1
        return e

    def number_at(self, v: np.ndarray) -> np.ndarray:
        """The number that holds that place of order 0."""
        return np.searchsorted(self.first, v, "right") - 1 if self.numbers is None else self.numbers.take(v)


def _run(numbers: np.ndarray | None, entries: np.ndarray | None, n: int, block: int, lanes: int, coder: _Coder, frame: _Frame) -> np.ndarray:
    """Codes (or decodes) the n numbers of all lanes, step by step: (block, lanes), the last lane may be shorter."""
    steps, bits = min(n, block), frame.bits
    out = np.zeros((steps, lanes), np.int64)
    lane = np.arange(lanes, dtype=np.int64)
    table = np.zeros(lanes << SLOTS, np.int32 if len(frame.symbol) < 1 << 28 else np.int64)
    weights = np.tile(_WEIGHTS, lanes)
    slots, sets, before, hashes = lane << SLOTS, lane * (CERTAIN + 1), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    full, last = 1 << WEIGHT, n - (lanes - 1) * block
    for t in range(steps):
        m = lanes if t < last else lanes - 1
        own, now = slice(0, m), before[:m]
        coder.settle(own)
        at = slots[:m] + hashes[:m]
        held = table.take(at).astype(np.int64)
        guess = held >> 3
        sure = (held & 7) * (frame.owner.take(guess) == now)
        of = sets[:m] + sure
        learnt = weights.take(of)
        weight = (learnt >> 16 - WEIGHT).astype(np.int64)
        others, extra, size = full - weight, weight << bits, frame.size.take(guess)
        if entries is not None:
            e = entries[t, :m]
        else:
            v = coder.sought(own, bits + WEIGHT)
            low = others * frame.start.take(guess)
            high = low + others * size + extra
            e = guess.copy()
            miss = np.flatnonzero((v < low) | (v >= high) | (sure == 0))
            v = v[miss]
            v -= extra[miss] * (v >= high[miss])
            e[miss] = frame.entry_at(now[miss], v // others[miss])
        hit = e == guess
        hit &= sure > 0
        begin, width = others * frame.start.take(e), others * frame.size.take(e)
        begin += extra * (guess < e)
        width += extra * hit
        coder.span(own, begin, width, bits + WEIGHT)
        share = (extra << 16) // (extra + others * size)
        weights[of] = np.minimum(learnt + ((share * hit - learnt) >> 5), MOST_WEIGHT)
        keep = hit | (sure > 2)
        count = np.where(hit, np.minimum(sure + 1, CERTAIN), np.where(keep, sure >> 1, 1))
        table[at] = np.where(keep, guess, e) << 3 | count
        x = frame.symbol.take(e)
        rest = np.flatnonzero(x < 0)
        if len(rest):
            coder.settle(rest)
            if numbers is not None:
                y = numbers[t, rest]
            else:
                y = frame.number_at(coder.sought(rest, bits))
            coder.span(rest, frame.first[y], frame.sizes[y], bits)
            x[rest] = y
        out[t, :m] = x
        hashes[:m] = ((now * 0x9E3779B1 + x * 0x85EBCA77 & 0xFFFFFFFF) * 0x2C1B3C6D & 0xFFFFFFFF) >> 32 - SLOTS
        before[:m] = x
    return out


#: Ids below this are counted in a table, others by sorting.
DENSE = 1 << 22
#: Distinct ids, listed pairs, ids, ids of a block, bytes of the packed model.
HEAD = struct.Struct("<IIQII")


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, byte by byte of all: they pack better."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view("<u8").ravel().astype(np.int64)


def encode(ids: np.ndarray, block: int) -> tuple[bytes, list[bytes]]:
    """(header, the bytes of each block of ``block`` ids); the last block may be shorter. Ids are unsigned 32-bit numbers."""
    n = len(ids)
    if not n:
        return HEAD.pack(0, 0, 0, block, 0), []
    if int(ids.max()) < DENSE:
        counts = np.bincount(ids)
        names = np.flatnonzero(counts)
        counts, at = counts[names], None
    else:
        names, at, counts = np.unique(ids, return_inverse=True, return_counts=True)
    by_count = np.argsort(-counts, kind="stable")
    counts = counts[by_count]
    number = np.zeros(len(names) if at is not None else int(names[-1]) + 1, np.int64)
    number[by_count if at is not None else names[by_count]] = np.arange(len(names))
    numbers = number[at if at is not None else ids]
    before = np.concatenate([[0], numbers[:-1]])
    before[::block] = 0
    keys = before * len(names) + numbers
    # Pairs are sorted with their places where both fit a number, so that each place gets its entry without a search.
    bits = n.bit_length()
    if (len(names) ** 2).bit_length() + bits < 64:
        keys = keys << bits | np.arange(n)
        keys.sort()
        order, ordered = keys & (1 << bits) - 1, keys >> bits
    else:
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
    del keys, before
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    times, each = np.diff(np.append(begins, n)), ordered[begins]
    del ordered, begins
    listed = np.flatnonzero(times >= LISTED)
    pairs = each[listed]
    frame = _Frame(counts, pairs, times[listed])
    at_each = frame.rests[each // len(names)]
    at_each[listed] = frame.place
    entries = np.empty(n, np.int64)
    entries[order] = np.repeat(at_each, times)
    times = times[listed]
    del order, each, at_each
    lanes = -(-n // block)
    steps = min(n, block)

    def side_by_side(values: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.append(values, np.zeros(lanes * steps - n, values.dtype)).reshape(lanes, steps).T)

    gaps = np.diff(pairs, prepend=0)
    packed = zlib.compress(names[by_count].astype("<u4").tobytes() + _planes(counts) + _planes(gaps) + _planes(times), 6)
    cost = (2 * frame.bits + WEIGHT + 8) // 8 + 1
    coder = _Coder(lanes, None, steps * cost + 64)
    _run(side_by_side(numbers), side_by_side(entries), n, block, lanes, coder, frame)
    return HEAD.pack(len(names), len(pairs), n, block, len(packed)) + packed, coder.finish()


def block_of(header: bytes) -> int:
    """Ids of a block."""
    return HEAD.unpack_from(header)[3]


def decode(header: bytes, blocks: list[bytes], only: int | None = None) -> np.ndarray:
    """The ids of encode()'s blocks; of one block, if ``only`` names it: then blocks has that one alone."""
    names, listed, n, block, size = HEAD.unpack_from(header)
    if not n:
        return np.zeros(0, np.uint32)
    raw = zlib.decompress(header[HEAD.size : HEAD.size + size])
    named, counts = np.frombuffer(raw, "<u4", names), _unplaned(raw, names, 4 * names)
    pairs, times = np.cumsum(_unplaned(raw, listed, 12 * names)), _unplaned(raw, listed, 12 * names + 8 * listed)
    total = n if only is None else min(block, n - only * block)
    width = max(map(len, blocks)) + 64
    data = np.zeros((len(blocks), width), np.uint8)
    for i, b in enumerate(blocks):
        data[i, : len(b)] = np.frombuffer(b, np.uint8)
    try:
        frame = _Frame(counts, pairs, times)
        frame.index()
        numbers = _run(None, None, total, block, len(blocks), _Coder(len(blocks), data, 0), frame)
        return named[numbers.T.ravel()[:total]]
    except IndexError as e:
        raise Damaged("a block does not decode") from e
