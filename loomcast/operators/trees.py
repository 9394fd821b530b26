"""Forests of many posterior draws as flat node arrays, walked for all draws, trees and rows at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CELLS = 1 << 20  # (tree, row) pairs that are walked at once


def list_sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)


@dataclass(frozen=True)
class Forests:
    """One forest for each draw.  owner: the draw of each tree; root: its first node; left and right: numbers of nodes."""

    draws: int
    owner: np.ndarray
    root: np.ndarray
    feat: np.ndarray
    thresh: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, column: pa.ListArray) -> Forests:
        """From an Arrow column of arrays of trees, which are arrays of nodes."""
        trees = column.flatten()
        sizes = list_sizes(trees)
        root = np.cumsum(sizes) - sizes
        feat, thresh, left, right, value = (x.to_numpy(zero_copy_only=False) for x in trees.flatten().flatten())
        base = np.repeat(root, sizes)
        return cls(len(column), np.repeat(np.arange(len(column)), list_sizes(column)), root, feat, thresh, left + base, right + base, value)

    def _leaves(self, at: np.ndarray, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The leaves that rows of x reach from the nodes at, going left where x[feat] <= thresh."""
        shape, at, row = at.shape, at.ravel().copy(), row.ravel()
        go = np.flatnonzero(self.feat[at] >= 0)
        while len(go):
            k = at[go]
            at[go] = np.where(x[row[go], self.feat[k]] <= self.thresh[k], self.left[k], self.right[k])
            go = go[self.feat[at[go]] >= 0]
        return at.reshape(shape)

    def values(self, x: np.ndarray) -> np.ndarray:
        """Each draw's forest at its own row of x."""
        return np.bincount(self.owner, self.value[self._leaves(self.root, x, self.owner)], minlength=self.draws)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Each draw's forest summed over all rows of x."""
        out, step = np.zeros(self.draws), max(1, CELLS // max(1, len(x)))
        for k in range(0, len(self.root), step):
            root, owner = self.root[k : k + step], self.owner[k : k + step]
            at = np.repeat(root[:, None], len(x), axis=1)
            row = np.broadcast_to(np.arange(len(x)), at.shape)
            out += np.bincount(owner, self.value[self._leaves(at, x, row)].sum(1), minlength=self.draws)
        return out
