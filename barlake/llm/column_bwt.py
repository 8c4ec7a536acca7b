"""Column-wise construction of a collection's Burrows-Wheeler transform.

The strings of a collection are aligned at their anchors and read from the right.
Each round inserts one symbol per string: the suffixes of the column, in the order
of the round before, are sorted stably by the new symbol, and the common prefix of
two neighbours is one more than the smallest common prefix between their places in
the round before.  A round reads the transform, the order and the common prefixes
of its predecessor from external files, front to back, and writes its own.

Equal substrings have equal anchors at equal offsets, so they always meet in the
same column: the transform is kept per column, and no round touches an earlier one.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence
from contextlib import ExitStack

import numpy as np


class _Files:
    """The arrays of one column as files that are written and read front to back;
    two sets take turns."""

    KINDS = {"order": np.int32, "common": np.uint8, "transform": np.uint8}

    def __init__(self, folder: str, opened: ExitStack):
        self.sets = [{kind: opened.enter_context(open(os.path.join(folder, f"{kind}.{turn}"), "w+b", buffering=0))
                      for kind in self.KINDS} for turn in (0, 1)]
        self.turn, self.rows = 0, 0

    def write(self, rows: int, **arrays: np.ndarray) -> None:
        self.turn ^= 1
        self.rows = rows
        for kind, values in arrays.items():
            file = self.sets[self.turn][kind]
            file.seek(0)
            file.write(np.ascontiguousarray(values, self.KINDS[kind]).data)

    def read(self) -> tuple[np.ndarray, ...]:
        out = []
        for kind, dtype in self.KINDS.items():
            file = self.sets[self.turn][kind]
            file.seek(0)
            out.append(np.frombuffer(file.read(self.rows * np.dtype(dtype).itemsize), dtype))
        return tuple(out)


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of ``values[lo:hi]`` for ranges that are not empty: neighbours that
    stay neighbours, the usual case, read one value; others use doubled spans."""
    out = values[lo]
    wide = np.flatnonzero(hi - lo > 1)
    if len(wide):
        lo, hi = lo[wide], hi[wide]
        level = np.frexp((hi - lo).astype(np.float32))[1] - 1
        depth = int(level.max()) + 1
        table = np.empty((depth, len(values)), values.dtype)
        table[0] = values
        for k in range(1, depth):
            span = 1 << (k - 1)
            table[k] = table[k - 1]
            np.minimum(table[k - 1, :-span], table[k - 1, span:], out=table[k, :-span])
        flat = table.ravel()
        base = level.astype(np.int64) * len(values)
        out[wide] = np.minimum(flat[base + lo], flat[base + hi - (np.int64(1) << level.astype(np.int64))])
    return out


def repeated_starts(strings: Sequence[bytes], anchors: Sequence[int], counts: Sequence[int], length: int) -> list[np.ndarray]:
    """For each string a mask over its starts: true where the ``length``-byte
    substring occurs at least twice in the collection, a string counting as often as
    ``counts`` says.  ``anchors`` are the offsets that the strings are aligned at;
    ``length`` is at most 255."""
    m = len(strings)
    size = np.fromiter(map(len, strings), np.int64, m)
    shift = np.asarray(anchors, np.int64)
    weight = np.asarray(counts, np.int64)
    left, right = -shift, size - 1 - shift
    first, last = int(left.min()), int(right.max())
    width = last - first + 1
    grid = np.zeros((m, width), np.uint8)
    for i, s in enumerate(strings):
        at = int(left[i]) - first
        grid[i, at:at + len(s)] = np.frombuffer(s, np.uint8)
    found = np.zeros((m, width), bool)
    by_right = np.argsort(-right, kind="stable")
    entered = 0
    with ExitStack() as opened:
        folder = opened.enter_context(tempfile.TemporaryDirectory(prefix="columns-"))
        path = os.path.join(folder, "symbols")
        np.ascontiguousarray(grid.T[::-1]).tofile(path)
        del grid
        files = _Files(folder, opened)
        with open(path, "rb") as symbols:
            ahead = np.frombuffer(symbols.read(m), np.uint8)
            for column in range(last, first - 1, -1):
                now, ahead = ahead, np.frombuffer(symbols.read(m), np.uint8)
                order, common, transform = files.read()
                going = np.flatnonzero(left[order] <= column)  # the others ended one column ago
                fresh = entered
                while entered < m and right[by_right[entered]] == column:
                    entered += 1
                new = by_right[fresh:entered]
                rows = np.concatenate([new, order[going]]).astype(np.int64)
                place = np.concatenate([np.full(len(new), -1), going])
                symbol = np.concatenate([now[new], transform[going]])
                rank = np.argsort(symbol, kind="stable")
                rows, place, symbol = rows[rank], place[rank], symbol[rank]
                prefix = np.zeros(len(rows), np.uint8)
                if len(rows) > 1:
                    same = symbol[1:] == symbol[:-1]
                    both = np.flatnonzero(same & (place[:-1] >= 0)) + 1
                    prefix[1:][same] = 1
                    if len(both):
                        lowest = _range_min(common, place[both - 1] + 1, place[both] + 1)
                        prefix[both] = np.minimum(lowest, length - 1) + 1
                group = np.cumsum(prefix < length)
                copies = np.bincount(group, weight[rows])[group] if len(rows) else np.zeros(0)
                # only starts with a whole substring before the end of their string count
                whole = right[rows] - column + 1 >= length
                found[rows, column - first] = (copies >= 2) & whole
                files.write(len(rows), order=rows, common=prefix,
                            transform=ahead[rows] if len(ahead) else np.zeros(len(rows)))
    return [found[i, int(left[i]) - first:int(left[i]) - first + max(0, len(s) - length + 1)] for i, s in enumerate(strings)]
