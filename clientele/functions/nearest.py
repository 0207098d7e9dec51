"""Nearest of many centres, exactly, for rows cut into leaves of neighbours.

Rows are halved along their widest column until a leaf holds a few dozen. The centre nearest to the middle of a leaf's box
rules out every centre that is farther from all of the box; rows of a leaf are compared with the others only. The labels
are those of a comparison with all centres, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LEAF_ROWS = 128
GATHERED_ROWS = 1 << 16  # rows that a task cuts into leaves at a time
LEAF_COLUMNS = 8  # boxes over more columns rule out few centres
CELLS_PER_BLOCK = 500_000  # distances a task holds at a time


def gathered(batches: Iterator[pa.RecordBatch], rows: int = GATHERED_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches joined to stretches of about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


class Leaves:
    """Rows in an order (``order``) in which each leaf is one stretch, with the boxes of the leaves."""

    def __init__(self, rows: np.ndarray, size: int = LEAF_ROWS) -> None:
        self.order, self.cuts = _halved(rows, size)
        self.rows = rows[self.order]
        starts = [begin for begin, _ in self.cuts]
        self.low = np.minimum.reduceat(self.rows, starts) if starts else np.empty((0, rows.shape[1]))
        self.high = np.maximum.reduceat(self.rows, starts) if starts else self.low

    def nearest(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row (in leaf order) the place of its nearest centre, the first of equals, and its squared distance less
        the row's own square."""
        label, near = np.empty(len(self.rows), dtype=np.int64), np.empty(len(self.rows))
        squares, doubled = (centres**2).sum(axis=1), -2 * centres
        block = max(1, CELLS_PER_BLOCK // len(centres))
        for at in range(0, len(self.cuts), block):
            for (begin, end), kept in zip(self.cuts[at : at + block], self._kept(at, at + block, centres, squares)):
                few = np.flatnonzero(kept)
                own, norms = doubled[few], squares[few][:, None]
                for first in range(begin, end, block):
                    last = min(first + block, end)
                    gaps = own @ self.rows[first:last].T
                    gaps += norms
                    place = gaps.argmin(axis=0)
                    label[first:last] = few[place]
                    near[first:last] = gaps[place, np.arange(last - first)]
        return label, near

    def _kept(self, begin: int, end: int, centres: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """(leaves x centres): whether a centre may be the nearest one somewhere in the leaf's box."""
        low, high = self.low[begin:end], self.high[begin:end]
        middle, half = (low + high) / 2, (high - low) / 2
        gaps = squares - 2 * middle @ centres.T
        best = gaps.argmin(axis=1)
        # How far the difference to the best centre can fall between the middle and a corner of the box.
        reach = np.zeros(gaps.shape)
        for d in range(centres.shape[1]):
            reach += np.abs(centres[best, d][:, None] - centres[None, :, d]) * half[:, d][:, None]
        slack = 1e-12 * (squares.max() + (np.maximum(np.abs(low), np.abs(high)) ** 2).sum(axis=1))
        least = gaps[np.arange(len(best)), best] + slack
        return ~(gaps - 2 * reach > least[:, None])


def _halved(rows: np.ndarray, size: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An order of the rows and the stretches of it that are leaves; equal rows are one leaf however many they are."""
    order, cuts, open_ = np.arange(len(rows)), [], [(0, len(rows))]
    while open_:
        begin, end = open_.pop()
        if end == begin:
            continue
        if end - begin > size:
            part = rows[order[begin:end]]
            spread = part.max(axis=0) - part.min(axis=0)
            widest = int(spread.argmax())
            if spread[widest] > 0:
                middle = (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(part[:, widest], middle)]
                open_ += [(begin + middle, end), (begin, begin + middle)]
                continue
        cuts.append((begin, end))
    return order, cuts
