"""Vectorised views of Arrow text batches: words, hashes and lines.

Everything here works on one bounded block of documents at a time, so memory
does not depend on the table's size.  Words are maximal runs of bytes that are
neither a blank (0x20) nor one of 0x09-0x0D; UTF-8 never uses those bytes
inside a character, hence byte-level splitting equals splitting on characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
MAX_ROWS = 1024
#: Powers kept between blocks; those that longer blocks need are made anew and dropped.
KEPT_POWERS = 1 << 21
#: Longer byte ranges are hashed by BLAKE2b, shorter ones eight bytes a step.
STEPPED = 1024

_BASE = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def configure(spark) -> None:
    """Keep Arrow batches small enough for Python workers whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.up, self.down
        while len(up) < n:
            m = len(up)
            up = np.concatenate([up, up * np.uint64(pow(_BASE, m, 1 << 64))])
            down = np.concatenate([down, down * np.uint64(pow(pow(_BASE, -1, 1 << 64), m, 1 << 64))])
        if len(self.up) < len(up) <= KEPT_POWERS:
            self.up, self.down = up, down
        return up[:n], down[:n]


POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads all bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


_SEED = np.uint64(0x243F6A8885A308D3)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of bytes.

    Every eight bytes go through a full mix of all bits, so that no text, however
    regular, collides by its form (as polynomials modulo 2**64 do).
    """
    size = end - start
    h = mix(size.astype(np.uint64) ^ _SEED)
    if not len(h):
        return h
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= STEPPED))
    at, left = start[live], size[live]
    while len(live):
        h[live] = mix(h[live] ^ (eight[at] & _KEEP[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > STEPPED).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


class Rolling:
    """Rolling (Karp-Rabin) hashes of windows of a sequence of 64-bit values, from prefix sums.

    For windows of few values which are hashes themselves; whatever is cut
    from raw bytes and must be told apart takes ``range_hashes``.
    """

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        up, self.down = POWERS.reach(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """Hashes of every window of the width, one for each start."""
        n = max(0, len(self.sums) - width)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n] + np.uint64(width))


class Block:
    """Some rows and their texts as one array of bytes."""

    def __init__(self, batch: pa.RecordBatch, column: str, lower: bool = False, blank: np.ndarray = BLANK, unspaced: bool = False) -> None:
        self.batch, self._blank, self._unspaced = batch, blank, unspaced
        text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
        _, ends, data = text.buffers()
        off = np.frombuffer(ends, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        self.data = raw[off[0] : off[-1]] if len(off) else raw[:0]
        if lower:
            self.data = LOWER[self.data]
        self.off = off - off[0] if len(off) else np.zeros(1, dtype=np.int64)

    def __len__(self) -> int:
        return self.batch.num_rows

    def split(self) -> None:
        """Find the words: start and end in bytes, and where each document's words begin."""
        solid = ~self._blank[self.data]
        edge = np.zeros(len(solid) + 1, dtype=bool)
        edge[self.off] = True
        if self._unspaced:
            # U+3000 to U+9FFF, three bytes each: every character is a word.
            lead = np.flatnonzero((self.data >= 0xE3) & (self.data <= 0xE9))
            edge[lead] = True
            edge[np.minimum(lead + 3, len(solid))] = True
        fresh = solid.copy()
        fresh[1:] &= ~solid[:-1] | edge[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:-1]
        self.start = np.flatnonzero(fresh)
        self.end = np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.ptr)

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def word_hashes(self) -> np.ndarray:
        """A hash of every word; splits the block."""
        self.split()
        return range_hashes(self.data, self.start, self.end)

    def per_doc(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sums of values between consecutive bounds."""
        sums = np.zeros(len(values) + 1, dtype=np.int64)
        np.cumsum(values, out=sums[1:])
        return np.diff(sums[bounds])


#: What tokenizing operators keep in a Python worker between their tasks; other operators' tasks in that worker drop it.
KEPT: list[dict] = []


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches to about size bytes of text and MAX_ROWS rows; one longer text makes a slice of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            used = total[at - 1] if at else 0
            to = min(at + MAX_ROWS, max(at + 1, int(np.searchsorted(total, used + size, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def blocks(batches: Iterator[pa.RecordBatch], column: str, lower: bool = False, size: int = BLOCK_BYTES, blank: np.ndarray = BLANK, unspaced: bool = False) -> Iterator[Block]:
    """The batches' slices as blocks."""
    for kept in KEPT:
        kept.clear()
    for batch in slices(batches, column, size):
        yield Block(batch, column, lower, blank, unspaced)


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given lengths: each element's run and its place in it."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return run, np.arange(len(run)) - first[run]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of the width that begins at one of the starts."""
    step = np.zeros(n + width + 1, dtype=np.int32)
    np.add.at(step, starts, 1) if len(starts) < 64 else step.__iadd__(np.bincount(starts, minlength=len(step)).astype(np.int32))
    step[width:] -= step[: len(step) - width].copy()
    return np.cumsum(step[:n]) > 0


class Recent(dict):
    """A cache of bounded bytes in two halves: a full younger half becomes the older one, whose entries come back on use.

    size(key, value) tells an entry's bytes besides what any entry takes; an entry
    of more than a 64th of the room is made anew each time.
    """

    ENTRY = 160

    def __init__(self, room: int, make, size=None) -> None:
        self.room, self.make, self.size, self.used, self.old = room, make, size, 0, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        own = self.ENTRY + (self.size(key, got) if self.size else 0)
        if own > self.room >> 6:
            return got
        if self.used + own > self.room:
            self.old, self.used = dict(self), 0
            self.clear()
        self.used += own
        self[key] = got
        return got
