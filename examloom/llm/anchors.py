"""Content-defined anchors: where long repeats must meet, wherever they stand.

Of every window of w units (bytes or words) the m consecutive units with the
smallest hash, the leftmost of these, are its anchor.  Equal windows have equal
anchors at equal places inside them, so a window that occurs twice has an
anchor whose hash occurs twice.  Neighbouring windows with the same anchor make
a segment of at most 2w - m units; each window lies in exactly one segment.
Only segments whose anchors occur twice are ever compared.

Long texts are taken in pieces that overlap by w - 1 units: memory is bounded by
the piece, and a segment that a piece's end cuts is two segments.
"""

from __future__ import annotations

import numpy as np

from examloom.llm.blocks import Rolling, range_hashes

PIECE = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of the width, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _piece(values: np.ndarray, bounds: np.ndarray, w: int, m: int) -> dict[str, np.ndarray]:
    """The segments of texts laid end to end with the given bounds."""
    n = len(values)
    # Of bytes, a hash by which windows are ordered; of words, which are hashes, the same.
    grams = Rolling((values.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).windows(m)
    least = sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), w - m + 1)
    # Windows must not leave their text.
    step = np.zeros(n + 1, dtype=np.int32)
    long = np.diff(bounds) >= w
    np.add.at(step, bounds[:-1][long], 1)
    np.add.at(step, bounds[1:][long] - w + 1, -1)
    valid = np.cumsum(step)[: len(least)] > 0
    at = np.where(valid, (least & _PLACE).astype(np.int64), -1)
    fresh = np.concatenate([[True], at[1:] != at[:-1]])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1
    good = at[first] >= 0
    start, end, anchor = first[good], last[good] + w, at[first[good]]
    size = values.itemsize
    f = range_hashes(values.view(np.uint8), start * size, end * size) ^ ((anchor - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return {"h": grams[anchor].view(np.int64), "f": f.view(np.int64), "start": start, "anchor": anchor, "end": end}


def segments(values: np.ndarray, bounds: np.ndarray, w: int, m: int) -> dict[str, np.ndarray]:
    """Of texts laid end to end with the given bounds, their segments: text, the anchor's hash h, the segment's hash f (which knows the anchor's place), and start, anchor and end in the text."""
    n = int(bounds[-1])
    parts = []
    for lo in range(0, max(1, n - w + 1), PIECE):
        hi = min(n, lo + PIECE + w - 1)
        if hi - lo >= w:
            got = _piece(np.ascontiguousarray(values[lo:hi]), np.clip(bounds - lo, 0, hi - lo), w, m)
            for k in ("start", "anchor", "end"):
                got[k] = got[k] + lo
            parts.append(got)
    if not parts:
        return {k: np.zeros(0, dtype=np.int64) for k in ("text", "h", "f", "start", "anchor", "end")}
    out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    out["text"] = np.searchsorted(bounds, out["start"], side="right") - 1
    base = bounds[out["text"]]
    return out | {k: out[k] - base for k in ("start", "anchor", "end")}


def runs_within(mask: np.ndarray, bounds: np.ndarray, w: int) -> list[list[int]]:
    """What the marked windows of each text cover, as a flat list of begin and end; bounds: where each text's windows begin, and the end."""
    # One unmarked place after each text keeps runs apart.
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    apart = np.zeros(len(mask) + len(bounds) + 1, dtype=np.int8)
    apart[np.arange(len(mask)) + text + 1] = mask
    edge = np.flatnonzero(np.diff(apart)).reshape(-1, 2)
    first = bounds + np.arange(len(bounds))
    owner = np.searchsorted(first, edge[:, 0], side="right") - 1
    edge = edge - first[owner][:, None]
    out: list[list[int]] = [[] for _ in range(len(bounds) - 1)]
    for i, a, b in zip(owner.tolist(), edge[:, 0].tolist(), edge[:, 1].tolist(), strict=True):
        own = out[i]
        if own and a <= own[-1]:
            own[-1] = b - 1 + w
        else:
            own += (a, b - 1 + w)
    return out
