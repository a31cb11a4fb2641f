"""Lowest common ancestors of a cell's pairs, from packed lists of ancestors that the cell gets once.

A task is one cell: first names, then lists, then pairs, which pass through in batches. Nodes are numbered in their order, so the least
number is the smallest node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: What a cell gets, in this order: names of the nodes at and above its right ends, lists of its right ends, lists of its left ends, pairs.
KINDS = ("names", "downs", "ups", "pairs")
NAMES, DOWNS, UPS, PAIRS = range(4)
#: Entries of lists that are held against each other at once.
SLICE = 2**20


class Lists:
    """Lists of (place, depth), each in the order of places and with its own node at depth 0; entries without a place are left out."""

    def __init__(self) -> None:
        self.lengths, self.places, self.depths = [], [], []

    def add(self, batch: pa.RecordBatch, nodes: np.ndarray) -> None:
        own, above = batch.column("id").to_numpy(), batch.column("ancestors")
        rows = np.arange(len(own))
        owner = np.concatenate([rows, np.repeat(rows, pc.fill_null(pc.list_value_length(above), 0).to_numpy())])
        node = np.concatenate([own, above.flatten().to_numpy()])
        depth = np.concatenate([np.zeros(len(own), np.int32), batch.column("depths").flatten().to_numpy()])
        place = np.searchsorted(nodes, node)
        there = np.flatnonzero(nodes[np.minimum(place, len(nodes) - 1)] == node) if len(nodes) else rows[:0]
        there = there[np.lexsort((place[there], owner[there]))]
        self.lengths.append(np.bincount(owner[there], minlength=len(own)))
        self.places.append(place[there].astype(np.int32))
        self.depths.append(depth[there].astype(np.int32))

    def close(self) -> None:
        empty = np.zeros(0, np.int32)
        self.lengths, self.places, self.depths = (np.concatenate([empty, *x]) for x in (self.lengths, self.places, self.depths))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def of(self, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rising keys (number of the row asked for, place) and depths of the lists of ``rows``."""
        n = self.lengths[rows]
        at = np.repeat(self.starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(rows)) * width, n) + self.places[at], self.depths[at]


class Cell:
    def __init__(self) -> None:
        self.kind, self.names, self.ids, self.left_names, self.right_ids = NAMES, [], [], [], []
        self.ups, self.downs = Lists(), Lists()

    def take(self, kind: int, batch: pa.RecordBatch) -> None:
        if kind == NAMES:
            self.names.append(batch.column("node"))
            self.ids.append(batch.column("id").to_numpy())
            return
        self._sorted()
        if kind == DOWNS:
            self.right_ids.append(batch.column("id").to_numpy())
            self.downs.add(batch, self.nodes)
        else:
            self.left_names.append(batch.column("node"))
            self.ups.add(batch, self.nodes)

    def _sorted(self) -> None:
        """Once all names are there: the nodes in their order."""
        if self.kind == NAMES:
            ids = np.concatenate([np.zeros(0, np.int64), *self.ids])
            order = np.argsort(ids)
            self.kind, self.nodes = DOWNS, ids[order]
            self.names = pa.concat_arrays(self.names).take(pa.array(order)) if self.names else None

    def close(self) -> None:
        """Once all lists are there."""
        self._sorted()
        self.ups.close()
        self.downs.close()
        self.lefts = pd.Index(_values(pa.concat_arrays(self.left_names))) if self.left_names else None
        right_ids = np.concatenate([self.nodes[:0], *self.right_ids])
        self.rights = pd.Index(_values(self.names.take(pa.array(np.searchsorted(self.nodes, right_ids))))) if len(right_ids) else None

    def judged(self, left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place of the lowest common ancestor and its distance, -1 for none."""
        common, distance = np.full(len(left), -1), np.full(len(left), -1)
        if self.lefts is None or self.rights is None:
            return common, distance
        a, b = _found(self.lefts, left), _found(self.rights, right)
        asked = np.flatnonzero((a >= 0) & (b >= 0))
        slices = np.cumsum(self.ups.lengths[a[asked]] + self.downs.lengths[b[asked]]) // SLICE
        for rows in np.split(asked, np.flatnonzero(np.diff(slices)) + 1):
            place, steps, which = self._met(a[rows], b[rows])
            common[rows[which]], distance[rows[which]] = place, steps
        return common, distance

    def _met(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = len(self.nodes)
        (up, above), (down, below) = self.ups.of(a, width), self.downs.of(b, width)
        if not len(up):
            return up, up, up
        at = np.minimum(np.searchsorted(up, down), len(up) - 1)
        hit = np.flatnonzero(up[at] == down)
        row, place = np.divmod(down[hit], width)
        rank = (above[at[hit]].astype(np.int64) + below[hit]) << 32 | place
        first = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.minimum.reduceat(rank, first) if len(first) else rank
        return best & (2**32 - 1), best >> 32, row[first]


def _values(column: pa.Array) -> np.ndarray:
    """Values to look up; texts as bytes, which need not be valid."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return column.to_numpy(zero_copy_only=False)


def _found(index: pd.Index, column: pa.Array) -> np.ndarray:
    """Places of values in ``index``, -1 for nulls and for what is not there."""
    out = np.full(len(column), -1)
    there = np.flatnonzero(pc.is_valid(column).to_numpy(zero_copy_only=False))
    out[there] = index.get_indexer(_values(column.take(pa.array(there))))
    return out


def _whole(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind, mask=values < 0)


def judge(left: str, right: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over cells in the order of kinds: the pairs with ``common`` and ``distance``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, number, closed = Cell(), None, False
        for batch in batches:
            cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            if not len(cells):
                continue
            number = cells[0] if number is None else number
            if (cells != number).any():
                raise RuntimeError("a task holds more than one cell")
            for kind in np.unique(kinds):
                lo, hi = np.searchsorted(kinds, [kind, kind + 1])
                part = batch.slice(lo, hi - lo)
                if kind < PAIRS:
                    cell.take(kind, part)
                    continue
                if not closed:
                    cell.close()
                    closed = True
                row = part.column("row")
                columns = dict(zip([f.name for f in row.type], row.flatten(), strict=True))
                place, distance = cell.judged(columns[left], columns[right])
                names = pa.nulls(len(place), columns[left].type) if cell.names is None else cell.names.take(_whole(place, pa.int64()))
                yield pa.RecordBatch.from_pydict(columns | {"common": names, "distance": _whole(distance, pa.int32())})

    return run
