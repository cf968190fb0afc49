"""An adaptive context-mixing range coder for token ids, in blocks that reset.

Each id is coded from three predictions. Order 2 and order 1 are tables of the id
that followed the last two ids, and the last one, with a confidence from 0 to 3
that hits raise and misses lower. Order 0 is a distribution over the ids of the
group: classes of about equal mass, whose shares adapt, and fixed shares of the
ids within a class. The mix is a row of 16 cumulative shares (order 2, order 1,
14 classes of order 0) for each pair of confidences, which moves towards what was
coded. An id takes the first of the three that has it.

Blocks of a group are coded side by side, a numpy lane each: step t codes the
t-th id of all blocks. Lanes share nothing but the group's order-0 shares: every
block starts from the same state, has its own words and its own crc32, and can be
decoded alone.

The coder keeps a 48-bit low and range and gives 16-bit words. A carry is added to
the word before it when a block is whole.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

BLOCK = 4096
CLASSES, CAP = 14, 8192
BITS = 14
ONE = 1 << BITS
RATE = 5
LOW = (1 << 32) - 1
HASH1, HASH2 = 10, 12
SYMBOLS = CLASSES + 2
#: What the ends of a row of shares move towards when a symbol is coded; every symbol keeps a share of one.
TARGET = np.array([[i if i <= s else ONE - SYMBOLS + i for i in range(1, SYMBOLS + 1)] for s in range(SYMBOLS)], np.int16)
#: Half a row, as numpy's largest type that is copied fast.
HALF = np.complex128
#: What a table holds where nothing followed yet: a place that no id has.
NEVER = 1 << 18
#: Each number below ONE, as often as a row has ends.
REPEATED = np.repeat(np.arange(ONE, dtype=np.int16), SYMBOLS).reshape(ONE, SYMBOLS)


@dataclass
class Shares:
    """Order 0 of a group: its ids, commonest first, their shares within their class, and how many ids each class has."""

    ids: np.ndarray
    share: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(ids: np.ndarray) -> tuple["Shares", np.ndarray]:
        """The shares for ids, and the ids as places in them."""
        if len(ids) and ids.max() < 1 << 20:
            every = np.bincount(ids)
            known = np.flatnonzero(every)
            count, place = every[known], None
        else:
            known, place, count = np.unique(ids, return_inverse=True, return_counts=True)
        if len(known) > CLASSES * CAP or len(known) > 1 << 16:
            raise ValueError(f"{len(known)} different ids in one group; the format holds 65,536")
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(known), np.int64)
        rank[order] = np.arange(len(known))
        mass, sizes, at = count[order], [], 0
        ends = np.cumsum(mass)
        for left in range(CLASSES, 0, -1):
            # An equal part of what is left, no more than CAP ids, and enough that the others hold the rest.
            done = ends[at - 1] if at else 0
            part = int(np.searchsorted(ends, done + (ends[-1] - done) / left)) + 1 - at if at < len(known) else 0
            part = min(max(part, len(known) - at - (left - 1) * CAP), CAP, len(known) - at)
            sizes.append(part)
            at += part
        share, at = np.empty(len(known), np.int64), 0
        for size in sizes:
            own = mass[at : at + size]
            if size:
                share[at : at + size] = np.maximum(1, own * (ONE - size) // own.sum())
                share[at] += ONE - share[at : at + size].sum()
            at += size
        if place is None:
            table = np.zeros(len(every), np.int64)
            table[known] = rank
            places = table.take(ids)
        else:
            places = rank[place.ravel()]
        return Shares(known[order].astype(np.uint32), share.astype(np.uint16), np.array(sizes, np.uint16)), places

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, start and share of each id in its class, id at each start)."""
        sizes, share = self.sizes.astype(np.int64), self.share.astype(np.int64)
        kind = np.repeat(np.arange(CLASSES), sizes)
        ends = np.cumsum(share)
        start = ends - share - kind * ONE  # every class that has ids has shares of ONE in all, and empty ones come last
        slots = np.zeros(CLASSES * ONE, np.int64)
        slots[: len(share) and int(ends[-1])] = np.repeat(np.arange(len(share)), share)
        return kind + 2, start, share, slots


class Lanes:
    """The predictions and the mix of n blocks.

    Both orders lie in one table, of place << 2 | confidence. A row of the mix is
    the ends of its 16 shares, the last ONE.
    """

    def __init__(self, n: int):
        self.table = np.full((n << HASH1) + (n << HASH2), NEVER, np.int32)
        self.ends = np.tile((np.arange(1, SYMBOLS + 1) * (ONE // SYMBOLS)).astype(np.int16), (n * 16, 1))
        self.flat, self.halves = self.ends.reshape(-1), self.ends.view(HALF).reshape(-1)
        self.base = np.array([np.arange(n) << HASH1, (n << HASH1) + (np.arange(n) << HASH2)]).reshape(2, n)
        self.base_mix = np.arange(n, dtype=np.int32) << 4
        self.last, self.before = np.zeros((2, n), np.uint16)  # of the last place, and of that before it times a factor

    def predict(self, a: int) -> None:
        """The predictions of the first a lanes."""
        last, self.at = self.last[:a], np.empty((2, a), np.int64)
        np.add(self.base[0, :a], last & ((1 << HASH1) - 1), out=self.at[0])
        np.add(self.base[1, :a], (last * 40503 + self.before[:a]) >> 4, out=self.at[1])  # the low 16 bits, of which HASH2 stay
        self.held = self.table.take(self.at)
        self.sure = self.held.astype(np.int8) & 3
        self.place = self.held >> 2
        self.row = ((self.sure[1] << 2 | self.sure[0]) + self.base_mix[:a]).astype(np.int64)
        self.rows = self.ends.take(self.row, 0)

    def shares(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, share) of symbols in the lanes' rows."""
        cell = (self.row << 4) + symbol
        start = self.flat.take(cell - 1) & (ONE - 1)  # before a row's first lies another's last, ONE
        return start, self.flat.take(cell) - start

    def learn(self, a: int, x: np.ndarray, symbol: np.ndarray, right: np.ndarray) -> None:
        """x (32 bits) and its symbol as the next of the first a lanes; right: which orders predicted it."""
        move = TARGET.take(symbol, 0)
        move -= self.rows
        move >>= RATE
        self.rows += move
        row = np.empty((a, 2), np.int64)
        np.left_shift(self.row, 1, out=row[:, 0])
        np.add(row[:, 0], 1, out=row[:, 1])
        self.halves[row] = self.rows.view(HALF)
        right, fresh = right.view(np.int8), x << 2 | 1
        kept = right | self.sure >> 1
        self.held += (right & (self.sure != 3)) + right - 1  # up to 3, or down
        self.held -= fresh
        self.held *= kept
        self.held += fresh
        self.table[self.at] = self.held
        self.before[:a] = self.last[:a] * 30011
        self.last[:a] = x


def _lengths(n: int, block: int) -> np.ndarray:
    lengths = np.full(-(-n // block), block, np.int64)
    if n % block:
        lengths[-1] = n % block
    return lengths


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[Shares, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shares, ids, words and crc32 of each block, all words)."""
    shares, places = Shares.of(ids)
    kind, start, share, _ = (np.append(x, first) for x, first in zip(shares.tables(), (0, 0, ONE, 0)))  # the last is for ids of orders 1 and 2
    lengths = _lengths(len(ids), block)
    n, steps = len(lengths), min(block, len(ids))
    x_all = np.zeros(n * block, np.uint16)
    x_all[: len(ids)] = places
    x_all = np.ascontiguousarray(x_all.reshape(n, block)[:, :steps].T)
    lanes, low, rng = Lanes(n), np.zeros(n, np.int64), np.full(n, 1 << 48, np.int64)
    room = steps * 2 + 8
    out, base = np.zeros(room * n, np.uint32), np.arange(n)  # the i-th words of all blocks side by side
    for t in range(steps):
        a = n if t < lengths[-1] else n - 1
        x = x_all[t, :a].astype(np.int32)
        lanes.predict(a)
        right = lanes.place == x
        hit = right[0] | right[1]
        own = (x + 1) * ~hit - 1  # the place, or the last
        symbol = kind.take(own) + (right[0] > right[1])
        lo, width = lanes.shares(symbol)
        lanes.learn(a, x, symbol, right)
        r = rng[:a] >> BITS
        value = low[:a] + r * lo
        r *= width
        r >>= BITS
        low[:a] = value + r * start.take(own)
        rng[:a] = r * share.take(own)
        short = rng <= LOW
        out[base] = low >> 32  # stays where the lane moves on
        base += n * short
        shift = short << 4
        low &= LOW | (short - 1)
        low <<= shift
        rng <<= shift
        while (rng <= LOW).any():
            short = np.flatnonzero(rng <= LOW)
            value = low.take(short)
            at = base.take(short)
            out[at] = value >> 32
            base[short] = at + n
            low[short] = (value & LOW) << 16
            rng[short] <<= 16
    out[base] = (low + LOW) >> 32  # one word that lies in the range, whatever follows
    used = base // max(n, 1) + 1
    words = out.reshape(room, n)[: int(used.max(initial=0))]
    for i in range(len(words) - 1, 0, -1):
        words[i - 1] += words[i] >> 16
    words = np.ascontiguousarray(words.astype(np.uint16).T)
    words = words[np.arange(words.shape[1]) < used[:, None]]
    raw = np.ascontiguousarray(ids, "<u4")
    crc = np.array([zlib.crc32(raw[i * block : i * block + block]) for i in range(n)], np.uint32)
    return shares, lengths.astype(np.uint32), used.astype(np.uint32), crc, words


def decode(shares: Shares, lengths: np.ndarray, used: np.ndarray, crc: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The ids of blocks, all of one length but the last; of one block alone too."""
    kind, start, share, slots = shares.tables()
    lengths = lengths.astype(np.int64)
    n, steps = len(lengths), int(lengths.max(initial=0))
    start, share, other = np.append(start, 0), np.append(share, ONE), len(start)
    ends = np.cumsum(used.astype(np.int64) + 4)
    at = ends - used.astype(np.int64) - 4
    stream = np.zeros(int(ends[-1]) if n else 0, np.int64)
    stream[np.arange(len(words)) + np.repeat(4 * np.arange(n), used)] = words  # each block's words, and zeros after them
    dif = stream.take(at) << 32 | stream.take(at + 1) << 16 | stream.take(at + 2) if n else at
    at, last_word = at + 3, ends - 1
    rng, lanes = np.full(n, 1 << 48, np.int64), Lanes(n)
    x_all = np.zeros((steps, n), np.uint16)
    for t in range(steps):
        a = n if t < lengths[-1] else n - 1
        lanes.predict(a)
        d, r = dif[:a], rng[:a] >> BITS
        # Both are under 2 ** 48 and the quotient is small: the division in doubles is exact after floor.
        v = np.minimum((d / r).astype(np.int64), ONE - 1)
        symbol = np.bitwise_count(np.packbits(lanes.rows <= REPEATED.take(v, 0)).view(np.uint16)).astype(np.int64)
        lo, width = lanes.shares(symbol)
        d = d - r * lo
        r *= width
        r >>= BITS
        v = np.minimum((d / r).astype(np.int64), ONE - 1)
        hit = symbol < 2
        x = slots.take(np.maximum(symbol - 2, 0) * ONE + v)
        own = np.where(hit, other, x)
        x = np.where(hit, np.where(symbol == 0, lanes.place[1], lanes.place[0]) & 0xFFFF, x).astype(np.int32)
        lanes.learn(a, x, symbol, lanes.place == x)
        dif[:a] = d - r * start.take(own)
        rng[:a] = r * share.take(own)
        x_all[t, :a] = x
        short = rng <= LOW
        shift = short << 4
        dif <<= shift
        dif |= stream.take(np.minimum(at, last_word)) * short
        at += short
        rng <<= shift
        while (rng <= LOW).any():
            short = np.flatnonzero(rng <= LOW)
            place = at.take(short)
            dif[short] = dif.take(short) << 16 | stream.take(np.minimum(place, last_word.take(short)))
            at[short] = place + 1
            rng[short] <<= 16
    ids = np.empty((n, steps), np.uint32)
    for i in range(0, n, 64):  # few blocks at once, whose lines stay in the cache
        ids[i : i + 64] = shares.ids.take(x_all[:, i : i + 64]).T
    ids = ids.reshape(-1)[: int(lengths.sum())]
    raw, ends = np.ascontiguousarray(ids, "<u4"), np.cumsum(lengths)
    for e, size, want in zip(ends.tolist(), lengths.tolist(), crc.tolist()):
        if zlib.crc32(raw[e - size : e]) != want:
            raise ValueError("a block doesn't have its checksum")
    return ids
