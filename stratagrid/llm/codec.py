"""Adaptive context-mixing range coder for token ids, in independently reset blocks.

Each id is predicted from the two ids before it (order 2) and from the one before it (order 1); both
predictions carry a confidence. The counts that each confidence has earned so far are added to mixed odds of
three events: the order-2 id, the order-1 id, or neither; in the last case the id's bytes follow by their
order-0 counts. A 32-bit carry-less range coder writes the events. All counts start anew with each block.

Blocks are independent, so many of them run in step as numpy lanes: one step codes one id of every block.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids of a block; slots of the order-1 and order-2 tables; confidences; weight of one id in the counts.
BLOCK, SLOTS1, SLOTS2, TRUST, EVENT_STEP, BYTE_STEP = 2048, 1024, 2048, 4, 8, 24
TOP, BOTTOM, WORD = np.uint64(1 << 24), np.uint64(1 << 16), np.uint64(0xFFFFFFFF)
EIGHT, SHIFT = np.uint64(8), np.uint64(24)


class _Lanes:
    """Models of all lanes. planes: bytes of an id, 1 to 4."""

    def __init__(self, lanes: int, planes: int):
        kind = np.uint16 if planes <= 2 else np.uint32
        none = np.iinfo(kind).max
        self.kind, self.planes, self.at = kind, planes, np.arange(lanes)
        self.id1, self.id2 = np.full(lanes * SLOTS1, none, kind), np.full(lanes * SLOTS2, none, kind)
        self.trust1, self.trust2 = np.zeros(lanes * SLOTS1, np.uint8), np.zeros(lanes * SLOTS2, np.uint8)
        start = np.tile(np.array([1, 1, 2], np.uint32), (lanes * TRUST * 2, 1))
        self.events1, self.events2 = start.copy(), start.copy()
        self.counts = [np.ones((lanes, 256), np.uint16) for _ in range(planes)]
        self.sums = [np.tile(np.arange(257, dtype=np.uint16), (lanes, 1)) for _ in range(planes)]
        self.prev, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)

    def predict(self, n: int) -> None:
        """Candidates and mixed odds for the next id of the first n lanes."""
        at, prev, before = self.at[:n], self.prev[:n], self.before[:n]
        self.s1 = at * SLOTS1 + (((prev * np.uint32(2654435761)) >> np.uint32(7)) & np.uint32(SLOTS1 - 1))
        self.s2 = at * SLOTS2 + ((((prev * np.uint32(2654435761)) ^ (before * np.uint32(2246822519))) >> np.uint32(9)) & np.uint32(SLOTS2 - 1))
        self.c1, self.c2 = self.id1[self.s1], self.id2[self.s2]
        self.t1, self.t2 = self.trust1[self.s1], self.trust2[self.s2]
        same = self.c1 == self.c2
        self.e1, self.e2 = (at * TRUST + self.t1) * 2 + same, (at * TRUST + self.t2) * 2 + same
        odds = self.events1[self.e1] + self.events2[self.e2]
        odds[same, 1] = 0
        self.f0, self.f1 = odds[:, 0].astype(np.uint64), odds[:, 1].astype(np.uint64)
        self.f2 = odds[:, 2].astype(np.uint64)

    def learn(self, n: int, ids: np.ndarray, event: np.ndarray) -> None:
        self.events1[self.e1, event] += np.uint32(EVENT_STEP)
        self.events2[self.e2, event] += np.uint32(EVENT_STEP)
        own = ids.astype(self.kind)
        for table, trust, slot, c, t in ((self.id1, self.trust1, self.s1, self.c1, self.t1), (self.id2, self.trust2, self.s2, self.c2, self.t2)):
            hit = c == own
            table[slot] = np.where(hit | (t > 0), c, own)
            trust[slot] = np.where(hit, np.minimum(t + 1, TRUST - 1), t - (t > 0))
        self.before[:n] = self.prev[:n]
        self.prev[:n] = ids

    def refresh(self, t: int) -> None:
        """Order-0 odds are brought up to the counts every few ids, often at first."""
        if t % 64 == 63 or t in (3, 7, 15, 31, 47):
            for counts, sums in zip(self.counts, self.sums, strict=True):
                np.cumsum(counts, axis=1, dtype=np.uint16, out=sums[:, 1:])


def _unsettled(low: np.ndarray, span: np.ndarray, lanes: np.ndarray | None) -> np.ndarray:
    """Lanes, of those given or all, whose top byte is due; a span that straddles a border while small is cut there."""
    a, b = (low, span) if lanes is None else (low[lanes], span[lanes])
    flat = (a ^ (a + b)) < TOP
    small = b < BOTTOM
    due = np.flatnonzero(flat | small)
    where = due if lanes is None else lanes[due]
    cut = where[~flat[due]]
    if len(cut):
        span[cut] = (~low[cut] + np.uint64(1)) & (BOTTOM - np.uint64(1))
    return where


class _Writer:
    def __init__(self, lanes: int, most: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, WORD)
        self.out, self.n = np.empty((lanes, most), np.uint8), np.zeros(lanes, np.int64)

    def put(self, at, start, count, total) -> None:
        low, span = self.low[at], self.range[at] // total
        low, span = (low + start * span) & WORD, span * count
        lanes = _unsettled(low, span, None)
        while len(lanes):
            where = lanes if isinstance(at, slice) else at[lanes]
            self.out[where, self.n[where]] = (low[lanes] >> SHIFT).astype(np.uint8)
            self.n[where] += 1
            low[lanes] = (low[lanes] << EIGHT) & WORD
            span[lanes] <<= EIGHT
            lanes = _unsettled(low, span, lanes)
        self.low[at], self.range[at] = low, span

    def done(self) -> list[bytes]:
        for _ in range(4):
            self.out[np.arange(len(self.n)), self.n] = (self.low >> SHIFT).astype(np.uint8)
            self.n += 1
            self.low = (self.low << EIGHT) & WORD
        return [self.out[i, :n].tobytes() for i, n in enumerate(self.n.tolist())]


class _Reader:
    def __init__(self, data: list[bytes]):
        longest = max(map(len, data)) + 8
        self.data = np.zeros((len(data), longest), np.uint8)
        for i, d in enumerate(data):
            self.data[i, : len(d)] = np.frombuffer(d, np.uint8)
        self.low, self.range = np.zeros(len(data), np.uint64), np.full(len(data), WORD)
        head = self.data[:, :4].astype(np.uint64)
        self.code = head[:, 0] << np.uint64(24) | head[:, 1] << np.uint64(16) | head[:, 2] << np.uint64(8) | head[:, 3]
        self.n = np.full(len(data), 4)

    def at(self, at, total) -> np.ndarray:
        """Where in the total the code lies."""
        self.span = self.range[at] // total
        return np.minimum(((self.code[at] - self.low[at]) & WORD) // self.span, total - np.uint64(1))

    def take(self, at, start, count) -> None:
        low, span, code = (self.low[at] + start * self.span) & WORD, self.span * count, self.code[at]
        lanes = _unsettled(low, span, None)
        while len(lanes):
            where = lanes if isinstance(at, slice) else at[lanes]
            code[lanes] = ((code[lanes] << EIGHT) & WORD) | self.data[where, np.minimum(self.n[where], self.data.shape[1] - 1)]
            self.n[where] += 1
            low[lanes] = (low[lanes] << EIGHT) & WORD
            span[lanes] <<= EIGHT
            lanes = _unsettled(low, span, lanes)
        self.low[at], self.range[at], self.code[at] = low, span, code


def _live(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes from the longest block to the shortest, and how many are that long at each step."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max(initial=0))
    return order, np.searchsorted(-lengths[order], -np.arange(longest), side="left")


def encode_blocks(blocks: list[np.ndarray], planes: int = 2) -> list[bytes]:
    """Codes of blocks of at most BLOCK ids each, below 256**planes."""
    lengths = np.array([len(b) for b in blocks])
    order, live = _live(lengths)
    if not len(live):
        return [b""] * len(blocks)
    ids = np.zeros((len(live), len(blocks)), np.uint32)  # step by step
    for lane, i in enumerate(order):
        ids[: lengths[i], lane] = blocks[i]
    model, out = _Lanes(len(blocks), planes), _Writer(len(blocks), (planes * 2 + 2) * len(live) + 16)
    for t, n in enumerate(live.tolist()):
        model.predict(n)
        x = ids[t, :n]
        event = np.where(x == model.c2, 0, np.where(x == model.c1, 1, 2))
        start = np.where(event == 0, np.uint64(0), np.where(event == 1, model.f0, model.f0 + model.f1))
        count = np.where(event == 0, model.f0, np.where(event == 1, model.f1, model.f2))
        out.put(slice(0, n), start, count, model.f0 + model.f1 + model.f2)
        at = np.flatnonzero(event == 2)
        if len(at):
            for p in range(planes):
                byte = (x[at] >> np.uint32(8 * p)) & np.uint32(255)
                sums = model.sums[p]
                low = sums[at, byte].astype(np.uint64)
                out.put(at, low, sums[at, byte + 1] - low, sums[at, 256].astype(np.uint64))
                model.counts[p][at, byte] += np.uint16(BYTE_STEP)
        model.learn(n, x, event)
        model.refresh(t)
    done, result = out.done(), [b""] * len(blocks)
    for lane, i in enumerate(order):
        result[i] = done[lane] if lengths[i] else b""
    return result


def decode_blocks(data: list[bytes], lengths: list[int], planes: int = 2) -> list[np.ndarray]:
    """Ids of blocks, as unsigned 32-bit integers."""
    sizes = np.array(lengths)
    order, live = _live(sizes)
    if not len(live):
        return [np.zeros(0, np.uint32) for _ in data]
    model, code = _Lanes(len(data), planes), _Reader([data[i] for i in order])
    ids = np.zeros((len(live), len(data)), np.uint32)
    for t, n in enumerate(live.tolist()):
        model.predict(n)
        every = slice(0, n)
        mid, high = model.f0, model.f0 + model.f1
        v = code.at(every, high + model.f2)
        event = (v >= mid).astype(np.int64) + (v >= high)
        start = np.where(event == 0, np.uint64(0), np.where(event == 1, mid, high))
        count = np.where(event == 0, model.f0, np.where(event == 1, model.f1, model.f2))
        code.take(every, start, count)
        x = np.where(event == 0, model.c2, model.c1).astype(np.uint32)
        at = np.flatnonzero(event == 2)
        if len(at):
            own = np.zeros(len(at), np.uint32)
            for p in range(planes):
                sums, row = model.sums[p].ravel(), at * 257
                v = code.at(at, sums[row + 256].astype(np.uint64))
                here, within = row.copy(), v.astype(np.uint16)
                for half in (128, 64, 32, 16, 8, 4, 2, 1):
                    here += half * (sums[here + half] <= within)
                byte, low = (here - row).astype(np.uint32), sums[here].astype(np.uint64)
                code.take(at, low, sums[here + 1] - low)
                model.counts[p][at, byte] += np.uint16(BYTE_STEP)
                own |= byte << np.uint32(8 * p)
            x[at] = own
        ids[t, :n] = x
        model.learn(n, x, event)
        model.refresh(t)
    result = [np.zeros(0, np.uint32)] * len(data)
    for lane, i in enumerate(order):
        result[i] = ids[: sizes[i], lane].copy()
    return result


def checksum(data: bytes) -> int:
    return zlib.crc32(data)
