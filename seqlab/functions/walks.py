"""The two-state smoother's walk, e -> clip(e + z, -limit, limit), over many rows at a time.

A step is a map x -> clip(x + shift, low, high), and two such maps in a row are one again, so a block of
any length is three numbers. Values are whole numbers of 2^-40, so it doesn't matter where blocks are cut:
sums are exact and every cut gives the same walk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

UNIT = float(1 << 40)
#: Beyond this a shift makes no difference: no walk is as wide.
WIDE = np.int64(1) << 50
#: Steps that a row of the two-level walk has.
ROW = 64


def fixed(x: np.ndarray | float) -> np.ndarray:
    """Log-odds as whole numbers; null (nan) is no evidence."""
    return np.rint(np.nan_to_num(np.asarray(x, dtype=np.float64)) * UNIT).astype(np.int64)


@dataclass
class Maps:
    """x -> clip(x + shift, low, high), as arrays."""

    shift: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __getitem__(self, at) -> Maps:
        return Maps(self.shift[at], self.low[at], self.high[at])

    def then(self, after: Maps) -> Maps:
        return Maps(np.clip(self.shift + after.shift, -WIDE, WIDE), np.clip(self.low + after.shift, after.low, after.high), np.clip(self.high + after.shift, after.low, after.high))

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x + self.shift, self.low, self.high)


def steps(z: np.ndarray, fresh: np.ndarray, limit: int) -> Maps:
    """A map for each row; where a sequence is fresh, whatever was before counts as even."""
    own = np.clip(z, -limit, limit)
    return Maps(np.where(fresh, 0, z), np.where(fresh, own, -limit), np.where(fresh, own, limit))


def padded(maps: Maps) -> Maps:
    """Rows of ROW steps; steps that do nothing fill the last."""
    n = -(-len(maps.shift) // ROW) * ROW
    fill = lambda x, v: np.concatenate([x, np.full(n - len(x), v, np.int64)]).reshape(-1, ROW)
    return Maps(fill(maps.shift, 0), fill(maps.low, -WIDE), fill(maps.high, WIDE))


def whole(maps: Maps) -> Maps:
    """All maps in a row as one (arrays of one)."""
    while len(maps.shift) > 1:
        rows = padded(maps)
        out = rows[:, 0]
        for k in range(1, ROW):
            out = out.then(rows[:, k])
        maps = out
    return maps


def walked(maps: Maps, start: int = 0) -> np.ndarray:
    """Where each step leads to, from start on."""
    n = len(maps.shift)
    if n <= ROW:
        out, x = np.zeros(n, np.int64), np.int64(start)
        for k in range(n):
            x = min(max(x + maps.shift[k], maps.low[k]), maps.high[k])
            out[k] = x
        return out
    rows = padded(maps)
    each = rows[:, 0]
    for k in range(1, ROW):
        each = each.then(rows[:, k])
    x = np.append(np.int64(start), walked(each, start)[:-1])
    out = np.empty(rows.shift.shape, np.int64)
    for k in range(ROW):
        x = rows[:, k].of(x)
        out[:, k] = x
    return out.reshape(-1)[:n]


def leads(z: np.ndarray, fresh: np.ndarray, limit: int, start: int = 0) -> tuple[np.ndarray, int]:
    """The lead of state 1 after each row, before it is clipped, and where the walk ends; start: where the one before ended."""
    if not len(z):
        return z, start
    e = walked(steps(z, fresh, limit), start)
    return np.where(fresh, 0, np.append(np.int64(start), e[:-1])) + z, int(e[-1])


def decided(d: np.ndarray, last: np.ndarray, limit: int) -> np.ndarray:
    """1 or 0 where a row's state is known by itself, else -1; last: a sequence's last row, which goes by the lead's sign."""
    return np.where(last, d > 0, np.where(d > limit, 1, np.where(d <= -limit, 0, -1))).astype(np.int8)


def filled(known: np.ndarray, after: int = -1) -> np.ndarray:
    """Each -1 replaced by the next known state; after: the state of the row behind the last, -1 if unknown."""
    at = np.where(known >= 0, np.arange(len(known)), len(known))
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(known, np.int8(after))[following]
