"""Adaptive range coder for token ids: order-0, order-1 and order-2 predictions mixed.

A block is coded on its own. Its ids are dealt into lanes, consecutive ids to a
lane; all lanes advance together and share one model, which learns from every
step. The model gives each id the probability

    w2 * [id follows the last two ids] + w1 * [id follows the last id] + w0 * p0(id)

where the first two name the id seen last in that context, p0 is the id's
frequency in the block so far, and the weights are learned for each combination
of how often both contexts were right in a row, from the first 32 steps and each
eighth after them. The range coder has 64-bit
states, carries into words given out before, and gives out 32 bits at a time, at
most once a step. The words of all lanes stand in the order they are read in.
All lanes take the same steps: what holds for some of them is multiplied in, as
picking them by a mask costs several times as much.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

_HEAD = struct.Struct("<4sIIIII")  # magic, ids, lanes, vocabulary, crc of ids, crc of the rest
_MAGIC = b"TKB3"
_KIND, _SYMBOL = 12, 20
_WHOLE = np.uint64(1 << _SYMBOL)
_LOW32 = np.uint64(0xFFFFFFFF)
_S32 = np.uint64(32)
_S5 = np.uint64(5)
#: Intervals hold their width below their begin.
_BELOW = np.uint64(_SYMBOL + 1)
_WIDTH = np.uint64((1 << _SYMBOL + 1) - 1)
_ID = (1 << 24) - 1
_ONE = 1 << 24
#: Packed predictions hold an id below its confidence, 0 to 3.
_TOP = 3 << 24
_TABLE = 16


class _Model:
    """Shared by coder and decoder, so both learn the same."""

    def __init__(self, lanes: int, vocabulary: int):
        self.vocabulary = vocabulary
        # Predictions after the last id, then those after the last two; all lanes' places in the first, then in the second.
        self.table = np.zeros(vocabulary + (1 << _TABLE), np.int32)
        self.at = np.zeros(2 * lanes, np.int64)
        self.at[lanes:] = vocabulary
        self.last = np.zeros(lanes, np.uint32)
        self.weights = np.ones((32, 3), np.int64)
        self.seen = np.zeros(vocabulary, np.int64)
        self.old, self.guess = np.zeros(2 * lanes, np.int32), np.zeros(2 * lanes, np.int32)
        self.pending: list[np.ndarray] = []
        self.step, self.next_count = 0, 1
        self._count()

    def _count(self) -> None:
        """The interval of each id: where it begins, and how wide it is."""
        if self.pending:
            self.seen += np.bincount(np.concatenate(self.pending), minlength=self.vocabulary)
            self.pending = []
        room = (1 << _SYMBOL) - self.vocabulary
        counts = np.cumsum(self.seen) if self.step else np.arange(1, self.vocabulary + 1)
        sums = np.zeros(self.vocabulary + 1, np.int64)
        # The products are whole numbers below 2 ** 53, and quotients round alike everywhere.
        sums[1:] = counts * float(room) / float(counts[-1])
        sums += np.arange(self.vocabulary + 1)
        self.width = np.diff(sums)
        self.interval = (sums[:-1].astype(np.uint64) << _BELOW) | self.width.astype(np.uint64)
        self.owner = None

    def symbols(self, values: np.ndarray) -> np.ndarray:
        """The id whose interval holds each value."""
        if self.owner is None:
            self.owner = np.repeat(np.arange(self.vocabulary, dtype=np.uint16 if self.vocabulary <= 1 << 16 else np.int32), self.width)
        return self.owner.take(values).astype(np.int64)

    def intervals(self, ids: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the intervals of the ids begin and how wide they are; all there is where ``other`` is 0, not 1."""
        packed = self.interval.take(ids)
        packed -= _WHOLE
        packed *= other
        packed += _WHOLE
        start = packed >> _BELOW
        packed &= _WIDTH
        return start, packed

    def predict(self):
        """Predictions of order 1 and 2; per weight context, where its three kinds begin and their shares (flat, by 4)."""
        if self.step == self.next_count:
            self._count()
            self.next_count = min(self.next_count * 2, self.next_count + 64)
        # The places are within the table; checking them costs a copy.
        self.table.take(self.at, mode="clip", out=self.old)
        guess = np.bitwise_and(self.old, _ID, out=self.guess).reshape(2, -1)
        first, second = self.old.reshape(2, -1)
        # Four cells for each context. Ids are below 2 ** 19, so only confidences are left of these.
        cell = second >> 19
        cell += first >> 21
        cell += (guess[0] == guess[1]).astype(np.int32) << 2
        self.cell = cell.astype(np.int64)
        if self.step < 32 or self.step % 8 == 0:
            total = self.weights.sum(axis=1, keepdims=True)
            share = np.zeros((32, 4), np.int64)
            share[:, :3] = 1 + self.weights * ((1 << _KIND) - 3) // total
            share[:, 2] = (1 << _KIND) - share[:, 0] - share[:, 1]
            begin = np.cumsum(share, axis=1) - share
            self.share, self.parts = share.ravel().astype(np.uint64), share.ravel().astype(np.float64)
            self.begin = begin.ravel().astype(np.uint64) << np.uint64(_SYMBOL)
            self.second, self.third = self.begin[1::4].repeat(4), self.begin[2::4].repeat(4)
        return guess

    def learn(self, ids: np.ndarray, cell: np.ndarray) -> None:
        if self.step < 32 or self.step % 8 == 7:
            self.weights += np.bincount(cell, minlength=128).reshape(32, 4)[:, :3]
        if self.step % 64 == 63:
            big = self.weights.sum(axis=1) > 1 << 20
            self.weights[big] = (self.weights[big] >> 1) + 1
        both = np.concatenate((ids, ids))
        hit = (self.guess == both).astype(np.int32)
        # A prediction gains a level if right and loses one if wrong; one below two gives way to the id.
        stays = self.old >> 25
        stays |= hit
        hit <<= 25
        new = self.old
        new += hit
        new -= _ONE
        self.guess += _TOP
        np.minimum(new, self.guess, out=new)
        both |= _ONE
        new -= both
        new *= stays
        new += both
        self.table[self.at] = new
        # Only the low bits count, so products may wrap.
        place = self.last * np.uint32(40503)
        self.last = ids.view(np.uint32)
        place += self.last * np.uint32(2654435761)
        place >>= 8
        place &= (1 << _TABLE) - 1
        place += self.vocabulary
        self.at[: len(ids)] = ids
        self.at[len(ids) :] = place
        self.pending.append(ids)
        self.step += 1


def _lanes(n: int) -> int:
    return max(1, min(4096, -(-n // 256)))


def _carry(out: np.ndarray, size: np.ndarray, lanes: np.ndarray) -> None:
    """Add one to the last of ``size`` words of the lanes, and to those before where it wraps."""
    at = size - 1
    while len(lanes):
        out[lanes, at] += np.uint32(1)
        on = out[lanes, at] == 0
        lanes, at = lanes[on], at[on] - 1


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """The ids, each below ``vocabulary``, as a self-contained block."""
    n = len(ids)
    if n and (int(ids.min()) < 0 or int(ids.max()) >= vocabulary) or not 0 < vocabulary <= 1 << 19:
        raise ValueError("ids must lie in the vocabulary, of at most 2 ** 19 ids")
    lanes = _lanes(n)
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(lanes, vocabulary)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    # By step and lane: the upper word of the low end, whether it is given out, whether the words before take a carry,
    # and the number of these.
    upper, gone, over = (np.empty((steps, lanes), kind) for kind in (np.uint32, bool, bool))
    sizes = np.zeros((steps + 1, lanes), np.int32)
    for t, x in enumerate(grid):
        p1, p2 = model.predict()
        missed, other = x != p2, x != p1
        other &= missed
        cell = model.cell
        cell += missed.view(np.int8) + other.view(np.int8)
        share = model.share.take(cell)
        start, width = model.intervals(x.astype(np.int64), other.astype(np.uint64))
        start *= share
        start += model.begin.take(cell)
        width *= share
        unit = span >> _S32
        start *= unit
        low += start
        np.less(low, start, out=over[t])
        span = np.multiply(width, unit, out=width)
        go = np.less_equal(span, _LOW32, out=gone[t])
        np.add(sizes[t], go, out=sizes[t + 1])
        upper[t] = low >> _S32
        shift = go.astype(np.uint64)
        shift <<= _S5
        low <<= shift
        span <<= shift
        model.learn(x, cell)
    size, sizes = sizes[-1].copy(), sizes.ravel()
    at, carried = np.flatnonzero(gone), np.flatnonzero(over)
    lane, place = at % lanes, sizes.take(at)
    out = np.zeros((lanes, int(size.max()) + 2), np.uint32)
    out[lane, place] = upper.ravel().take(at)
    # A word takes one carry at most, so all can be added at once.
    _carry(out, sizes.take(carried), carried % lanes)
    for part in (low >> _S32, low & _LOW32):
        out[np.arange(lanes), size] = part
        size += 1
    # A lane is read two words ahead: one moves up for each that was given out.
    rest = np.concatenate([out[:, 0], out[:, 1], out[lane, place + 2]]).astype("<u4").tobytes()
    return _HEAD.pack(_MAGIC, n, lanes, vocabulary, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(rest)) + rest


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block; ValueError if its bytes or its ids do not match their checksums."""
    if len(data) < _HEAD.size:
        raise ValueError("token block is too short")
    magic, n, lanes, vocabulary, crc_ids, crc_rest = _HEAD.unpack_from(data)
    rest = data[_HEAD.size :]
    if magic != _MAGIC or zlib.crc32(rest) != crc_rest:
        raise ValueError("token block is damaged")
    words = np.frombuffer(rest, "<u4")
    steps = -(-n // lanes)
    grid = np.zeros((steps, lanes), np.int32)
    model = _Model(lanes, vocabulary)
    # The code less the low end of its interval.
    code, span = words[:lanes].astype(np.uint64) << _S32, np.full(lanes, 2**64 - 1, np.uint64)
    code |= words[lanes : 2 * lanes]
    read, more = 2 * lanes, np.zeros(lanes, np.uint64)
    for t in range(steps):
        p1, p2 = model.predict()
        unit = span >> _S32
        value = code // unit
        np.minimum(value, _LOW32, out=value)
        cell = model.cell
        missed, other = value >= model.second.take(cell), value >= model.third.take(cell)
        cell += missed.view(np.int8) + other.view(np.int8)
        share = model.share.take(cell)
        begin = model.begin.take(cell)
        # Both are below 2 ** 32, so the quotient's whole part is exact.
        value -= begin
        inside = value.view(np.int64).astype(np.float64)
        inside /= model.parts.take(cell)
        # Of the others, all look up the same symbol.
        inside *= other
        found = model.symbols(inside.astype(np.int64))
        # The first guess, the second or the symbol.
        x = grid[t]
        np.subtract(p1, p2, out=x)
        x *= missed
        x += p2
        symbol = found.astype(np.int32)
        symbol -= x
        symbol *= other
        x += symbol
        start, width = model.intervals(found, other.astype(np.uint64))
        start *= share
        start += begin
        width *= share
        start *= unit
        code -= start
        span = np.multiply(width, unit, out=width)
        go = span <= _LOW32
        shift = go.astype(np.uint64)
        shift <<= _S5
        code <<= shift
        span <<= shift
        until = read + int(np.count_nonzero(go))
        more.fill(0)
        more[go] = words[read:until]
        code |= more
        read = until
        model.learn(x, cell)
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("token block does not hold the ids it was made from")
    return ids
