"""Suffix-array dedup by column-wise multi-document construction (operator 3).

The collection Burrows-Wheeler transform of many strings is built by columns:
each round puts in front of every string's suffix one more symbol, at the row
that the transform itself tells (Bauer, Cox and Rosone, 2011), and carries the
common prefixes of neighbouring rows along (Cox et al., 2016).  Transform and
common prefixes lie in two external files.  Each round reads them twice, front
to back and ``CHUNK`` rows at a time, and writes them once: first to find the
new rows and what they share with their neighbours, then to merge these in.
At the end a walk through the transform tells whose suffix each row is, and rows
that share ``WINDOW`` bytes or more with a neighbour are repeats.

The strings are the distinct segments around anchors that occur again (see
``repeats``), each with the number of its occurrences as its weight: equal
strings would be neighbours over their whole length.  Before, they are cut down
on both sides to what they share with any other segment of their anchor, as no
more of them can be found again, and those with less than a window left are
done with.  An anchor with one distinct segment makes no collection: its only
string occurs twice or more, hence repeats as a whole.

Null or empty text: 0 bytes, nothing removed.  Matches never cross documents.
Every row is a document: rows with equal or null ids are compared like others,
so a row that occurs twice loses whatever is long enough.  Characters that a
repeat's edge cuts in two lose their rest in ``without_repeats`` only.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


from examloom.llm.blocks import blocks, configure
from examloom.llm.repeats import Units, covered_mask, covers, with_runs

WINDOW = 200
ANCHOR = 50
#: Rows of the external files in memory at a time (22 bits hold one).
CHUNK = 1 << 20
_ROW_BITS, _ROW = np.uint32(22), np.uint32((1 << 22) - 1)


class Files:
    """The transform and the common prefixes in external files, two of each, which rounds write by turns.

    All four stay open and are written over from the front, as each round's are
    longer than those before.  (Cutting a file first would make it wait for the disk.)
    """

    def __init__(self, folder: str, kinds: tuple) -> None:
        self.kinds, self.turn, self.rows = kinds, 0, 0
        self.open = [[open(os.path.join(folder, f"{name}.{k}"), "w+b", buffering=0) for name in ("bwt", "lcp")] for k in range(2)]

    def close(self) -> None:
        for f in itertools.chain(*self.open):
            f.close()

    def _part(self, which: int, lo: int) -> np.ndarray:
        out = np.empty(min(CHUNK, self.rows - lo), dtype=self.kinds[which])
        f, room = self.open[self.turn][which], memoryview(out).cast("B")
        f.seek(lo * out.itemsize)
        while len(room):
            got = f.readinto(room)
            if not got:
                raise EOFError("an external file ends too early")
            room = room[got:]
        return out

    def read(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First row, symbols and common prefixes of each chunk."""
        for lo in range(0, self.rows, CHUNK):
            yield lo, self._part(0, lo), self._part(1, lo)

    def write(self, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        """The next round's files, which then are this round's."""
        n, to = 0, self.open[1 - self.turn]
        for f in to:
            f.seek(0)
        for columns in parts:
            for f, x, kind in zip(to, columns, self.kinds, strict=True):
                data = memoryview(np.ascontiguousarray(x, dtype=kind)).cast("B")
                while len(data):
                    data = data[f.write(data) :]
            n += len(columns[0])
        self.turn, self.rows = 1 - self.turn, n


def range_minima(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of x over [lo, hi), none empty."""
    order = np.argsort(lo, kind="stable")
    cut = np.stack([lo[order], hi[order]], axis=1).ravel()
    out = np.empty(len(lo), dtype=np.int64)
    if not len(lo):
        return out
    out[order] = np.minimum.reduceat(np.append(x, x[-1]), cut)[::2]
    return out


class Collection:
    """The transform of nonempty strings, with prefixes shared by neighbouring rows up to a cap."""

    def __init__(self, strings: list[bytes], cap: int, folder: str) -> None:
        self.size = np.array([len(s) for s in strings])
        self.flat, self.end = np.frombuffer(b"".join(strings), dtype=np.uint8), np.cumsum(self.size)
        self.alphabet = int(self.flat.max()) + 2  # symbol 0 stands before a string's first
        self.cap, self.k = cap, len(strings)
        self.numbers, self.symbols = np.arange(CHUNK, dtype=np.uint32), np.arange(self.alphabet, dtype=np.uint32) << _ROW_BITS
        self.files = Files(folder, (np.uint8 if self.alphabet <= 256 else np.uint16, np.uint8 if cap <= 255 else np.uint16))
        last = self._symbol(np.arange(self.k), 0)
        self.totals = np.bincount(last, minlength=self.alphabet)
        self.files.write((last[i : i + CHUNK], np.zeros(len(last[i : i + CHUNK]))) for i in range(0, self.k, CHUNK))
        row, live = np.arange(self.k), np.arange(self.k)
        for length in range(1, int(self.size.max()) + 1):
            row[live], live = self._insert(row[live], live, length)

    def _symbol(self, which: np.ndarray, length: int) -> np.ndarray:
        """What stands before the suffixes of the length."""
        return np.where(self.size[which] > length, self.flat[np.maximum(self.end[which] - 1 - length, 0)].astype(np.int64) + 1, 0)

    def _base(self) -> np.ndarray:
        """The row of the first suffix that begins with each symbol."""
        return self.k + np.cumsum(self.totals) - self.totals - self.totals[0]

    def _insert(self, at: np.ndarray, live: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Insert the suffixes of the length; at: rows of those that they extend.  Returns their rows, and which strings go on."""
        order = np.argsort(at)
        place, before, after = self._find(at[order], self._symbol(live[order], length - 1))
        symbol = self._symbol(live[order], length)
        by = np.argsort(place)
        self.files.write(self._merged(place[by], symbol[by], before[by], after[by]))
        self.totals = self.totals + np.bincount(symbol, minlength=self.alphabet)
        new = np.empty(len(at), dtype=np.int64)
        new[order] = place
        return new, live[self.size[live] > length]

    def _find(self, at: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For suffixes got by putting c before those of the rows at (in order): their rows, and what they share with the rows before and after (-1: another symbol)."""
        place, before, after = np.empty(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64), np.full(len(at), -1)
        base, seen = self._base(), np.zeros(self.alphabet, dtype=np.int64)
        least = np.full(self.alphabet, self.cap)  # of the common prefixes since a symbol's last row so far
        owed = np.full(self.alphabet, -1)  # the suffix of that row, if it is one of these
        for lo, bwt, lcp in self.files.read():
            n = len(bwt)
            a, z = np.searchsorted(at, (lo, lo + n))
            pos, x = at[a:z] - lo, c[a:z]
            # Symbol and row in one number: sorted, the rows of each symbol follow each other.
            keys = (bwt.astype(np.uint32) << _ROW_BITS) | self.numbers[:n]
            mine = (x.astype(np.uint32) << _ROW_BITS) | pos.astype(np.uint32)
            keys.sort()
            begin = np.searchsorted(keys, self.symbols)
            count = np.diff(begin, append=n)
            turn = np.searchsorted(keys, mine)
            place[a:z] = base[x] + seen[x] + turn - begin[x]
            left = turn > begin[x]
            before[a:z][left] = range_minima(lcp, (keys[turn[left] - 1] & _ROW) + 1, pos[left] + 1) + 1
            right = turn + 1 < begin[x] + count[x]
            after[a:z][right] = range_minima(lcp, pos[right] + 1, (keys[turn[right] + 1] & _ROW) + 1) + 1
            if lo or lo + n < self.files.rows:
                there = np.flatnonzero(count)
                first, final = keys[begin[there]] & _ROW, keys[begin[there] + count[there] - 1] & _ROW
            if lo:
                so_far = np.minimum.accumulate(lcp)
                far = ~left & (seen[x] > 0)
                before[a:z][far] = np.minimum(least[x[far]], so_far[pos[far]]) + 1
                due = owed[there] >= 0
                after[owed[there[due]]] = np.minimum(least[there[due]], so_far[first[due]]) + 1
            if lo + n < self.files.rows:
                to_come = np.append(np.minimum.accumulate(lcp[::-1])[::-1], self.cap)
                np.minimum(least, int(to_come[0]), out=least)
                at_row = np.full(n, -1)
                at_row[pos] = np.arange(a, z)
                least[there], owed[there] = to_come[final + 1], at_row[final]
            seen += count
        return place, np.minimum(before, self.cap), np.minimum(after, self.cap)

    def _merged(self, place: np.ndarray, symbol: np.ndarray, before: np.ndarray, after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The files' chunks with the new rows in between; the common prefix of an old row right after a new one is set anew."""
        old = place - np.arange(len(place))  # the old row that each comes before
        follows = (after >= 0) & (np.append(place[1:], -1) != place + 1)
        for lo, bwt, lcp in self.files.read():
            n = len(bwt)
            a, z = np.searchsorted(old, (lo, lo + n if lo + n < self.files.rows else self.files.rows + 1))
            change = np.flatnonzero(follows[a:z]) + a
            lcp[old[change] - lo] = after[change]
            if z == a:
                yield bwt, lcp
                continue
            fresh = old[a:z] - lo + np.arange(z - a)
            kept = np.ones(n + z - a, dtype=bool)
            kept[fresh] = False
            columns = np.empty(len(kept), dtype=bwt.dtype), np.empty(len(kept), dtype=lcp.dtype)
            for to, was, new in zip(columns, (bwt, lcp), (symbol, before), strict=True):
                to[kept], to[fresh] = was, new[a:z]
            yield columns

    def walk(self) -> tuple[np.ndarray, np.ndarray]:
        """The string and the length of every row's suffix."""
        step = np.full(self.files.rows, -1, dtype=np.int64)
        base = self._base()
        for lo, bwt, _ in self.files.read():
            order = np.argsort(bwt, kind="stable")
            count = np.bincount(bwt, minlength=self.alphabet)
            sorted_bwt = bwt[order]
            step[lo + order] = base[sorted_bwt] + np.arange(len(bwt)) - (np.cumsum(count) - count)[sorted_bwt]
            base = base + count
        owner, length = np.arange(self.files.rows), np.zeros(self.files.rows, dtype=np.int64)
        row, live = np.arange(self.k), np.arange(self.k)
        for n in range(1, int(self.size.max()) + 1):
            row = step[row]
            owner[row], length[row] = live, n
            more = self.size[live] > n
            row, live = row[more], live[more]
        return owner, length

    def shared(self) -> np.ndarray:
        return np.concatenate([lcp for _, _, lcp in self.files.read()]).astype(np.int64)


def construct(strings: list[bytes], cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all suffixes of nonempty strings, in sorted order: the string, the length, and the prefix shared with the suffix before (up to cap)."""
    with tempfile.TemporaryDirectory() as folder:
        made = Collection(strings, cap, folder)
        try:
            return *made.walk(), made.shared()
        finally:
            made.files.close()


def extents(h: list[int], sides: list[bytes]) -> list[int]:
    """The longest prefix that each string shares with another of its group."""
    order = sorted(range(len(sides)), key=lambda i: (h[i], sides[i]))
    out = [0] * len(sides)
    for i, j in itertools.pairwise(order):
        if h[i] == h[j]:
            n = min(len(sides[i]), len(sides[j]))
            n -= ((int.from_bytes(sides[i][:n]) ^ int.from_bytes(sides[j][:n])).bit_length() + 7) // 8
            out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def shard(columns: dict[str, list], w: int = WINDOW) -> Iterator[tuple[int, list[int], list[int]]]:
    """What of each segment is covered by windows that occur again."""
    h, times, parts = columns["h"], columns["n"], columns["content"]
    at = [a - s for a, s in zip(columns["a"], columns["s"], strict=True)]
    right = extents(h, [x[a:] for x, a in zip(parts, at, strict=True)])
    left = extents(h, [x[:a][::-1] for x, a in zip(parts, at, strict=True)])
    groups: dict[tuple[int, int, bytes], list[int]] = {}
    for i, (x, a, le, ri, n) in enumerate(zip(parts, at, left, right, times, strict=True)):
        if n > 1:
            le, ri = a, len(x) - a  # occurs again as a whole
        if le + ri >= w:
            groups.setdefault((h[i], le, x[a - le : a + ri]), []).append(i)
    if not groups:
        return
    lefts, strings, members = [le for _, le, _ in groups], [x for _, _, x in groups], list(groups.values())
    weight = np.array([sum(times[i] for i in m) for m in members])
    owner, length, lcp = construct(strings, w)
    again = lcp >= w
    again[:-1] |= lcp[1:] >= w
    row = np.flatnonzero((length >= w) & (again | (weight[owner] > 1)))
    row = row[np.lexsort((-length[row], owner[row]))]
    cut = np.flatnonzero(np.diff(owner[row], prepend=-1, append=-1))
    for a, b in itertools.pairwise(cut.tolist()):
        k = int(owner[row[a]])
        runs: list[int] = []
        for s in (len(strings[k]) - length[row[a:b]]).tolist():
            if runs and s <= runs[-1]:
                runs[-1] = s + w
            else:
                runs += (s, s + w)
        for i in members[k]:
            shift = at[i] - lefts[k]
            yield i, (own := [shift + x for x in runs]), own


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per distinct document with a repeat: id, th and what is covered, in bytes."""
    return covers(docs, Units(False, WINDOW, ANCHOR), shard, settle=True, key=key, text=text)


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_bytes, n_removed, n_spans and kept_sha256."""
    configure(docs.sparkSession)
    marked, runs_column = with_runs(docs.select(key, text), repeats(docs, key, text), key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            mask = covered_mask(block.batch.column(runs_column), block.off)
            begins = mask & ~np.concatenate([[False], mask[:-1]])
            begins[block.off[:-1][np.diff(block.off) > 0]] |= mask[block.off[:-1][np.diff(block.off) > 0]]
            gone, spans = block.per_doc(mask, block.off), block.per_doc(begins, block.off)
            sha = [hashlib.sha256(data[~own] if own is not None else data).hexdigest() for data, own in _cut(block, mask, gone)]
            yield pa.RecordBatch.from_arrays([block.batch.column(key), *map(pa.array, (np.diff(block.off), gone, spans)), pa.array(sha, pa.string())], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut(block, mask: np.ndarray, gone: np.ndarray):
    """Each text and what of it is covered, None if nothing is."""
    for a, b, n in zip(block.off[:-1].tolist(), block.off[1:].tolist(), gone.tolist(), strict=True):
        yield block.data[a:b], mask[a:b] if n else None


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """All rows, with the repeats cut out of their texts (characters cut in two go too) and the size column, if there, set anew."""
    configure(docs.sparkSession)
    names = docs.columns
    marked, runs_column = with_runs(docs, repeats(docs, key, text), key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            old, new = block.batch.column(text), []
            mask = covered_mask(block.batch.column(runs_column), block.off)
            for i, (data, own) in enumerate(_cut(block, mask, block.per_doc(mask, block.off))):
                new.append(old[i].as_py() if own is None else data[~own].tobytes().decode("utf-8", "ignore"))
            cols = {c: block.batch.column(c) for c in names}
            changed = block.batch.column(runs_column).is_valid()
            cols[text] = pa.array(new, pa.string())
            if size in cols:
                cols[size] = pc.if_else(changed, pc.utf8_length(cols[text]).cast(cols[size].type), cols[size])
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return marked.mapInArrow(run, docs.schema)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
