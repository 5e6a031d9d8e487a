"""Learned index from ranks to offsets: piecewise lines with stored residuals.

Boundary number i of a text lies at offset o(i). Offsets grow almost evenly, so a few lines
give each of them within ``BOUND``; the difference is stored as one signed byte per boundary,
and an offset is its line's value, rounded down, plus that byte: exact, from about an
eighth of the memory of plain 64-bit offsets and a search among few segments.

A run of boundaries gets one line if some line through its first boundary passes all others
within the bound: the slopes that do so are an interval, the intersection of one interval
per boundary. A run for which the intersection is empty is halved and both halves are tried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BOUND = 120
#: Longest run that is tried at first.
SPAN = 8192


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places first[i], first[i] + 1, ..., first[i] + sizes[i] - 1, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class RankIndex:
    """Segments in ascending order of their first place, and a residual for every place."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def offsets(self, places: np.ndarray) -> np.ndarray:
        """The exact offsets at some places of the fitted array."""
        places = np.asarray(places, dtype=np.int64)
        s = np.searchsorted(self.first, places, "right") - 1
        steps = places - self.first[s]
        return self.base[s] + np.floor(self.slope[s] * steps).astype(np.int64) + self.residual[places]

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.first, self.base, self.slope, self.residual))


def fit(offsets: np.ndarray, starts: np.ndarray, bound: int = BOUND, span: int = SPAN) -> RankIndex:
    """The index over several texts' boundary offsets, laid one text after the other.

    Text t has the places starts[t] to starts[t + 1] - 1; no segment spans two texts. A
    text may have any number of boundaries, none included.
    """
    if not 0 < bound <= 126:
        raise ValueError("residuals of one byte need a bound of 1 to 126")
    offsets = np.asarray(offsets, dtype=np.int64)
    sizes = np.diff(starts)
    # runs of at most span places
    parts = -(-sizes // span)
    inner = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(np.asarray(starts[:-1]), parts) + inner * span
    count = np.minimum(np.repeat(np.asarray(starts[1:]), parts) - first, span)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    residual = np.zeros(len(offsets), dtype=np.int8)
    while len(first):
        places = spread(first, count)
        runs = np.cumsum(count) - count
        steps = places - np.repeat(first, count)
        rise = offsets[places] - np.repeat(offsets[first], count)
        with np.errstate(divide="ignore"):
            low = np.where(steps > 0, (rise - bound) / steps, -np.inf)
            high = np.where(steps > 0, (rise + bound) / steps, np.inf)
        least, most = np.maximum.reduceat(low, runs), np.minimum.reduceat(high, runs)
        fits = least <= most
        with np.errstate(invalid="ignore"):
            slope = np.where(count > 1, (least + most) / 2, 0.0)
        good = np.repeat(fits, count)
        line = np.floor(np.repeat(slope, count)[good] * steps[good]).astype(np.int64)
        residual[places[good]] = rise[good] - line
        found.append((first[fits], slope[fits]))
        bad, n = first[~fits], count[~fits]
        half = (n + 1) // 2
        first, count = np.concatenate([bad, bad + half]), np.concatenate([half, n - half])
        order = np.argsort(first)
        first, count = first[order], count[order]
    if not found:
        none = np.zeros(0, np.int64)
        return RankIndex(none, none, np.zeros(0), residual)
    heads, slopes = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(heads)
    return RankIndex(heads[order], offsets[heads[order]], slopes[order], residual)
