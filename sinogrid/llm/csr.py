"""Sparse integer matrices by rows, and their products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


def _gathered(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions starts[k], starts[k] + 1, ... (counts[k] of them) for each k in turn."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


@dataclass(frozen=True)
class Csr:
    """Row r holds `values` at `columns`, both from bounds[r] to bounds[r + 1]; columns of a row differ."""

    bounds: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @staticmethod
    def of(rows: np.ndarray, columns: np.ndarray, height: int, width: int, values: np.ndarray | None = None) -> Csr:
        """From entries in any order; entries of one place are added."""
        values = np.ones(len(rows), np.int64) if values is None else values
        place = rows.astype(np.int64) * width + columns
        step = np.diff(place)
        if (step <= 0).any():
            if (step < 0).any():
                order = np.argsort(place, kind="stable")
                place, rows, columns, values = place[order], rows[order], columns[order], values[order]
            first = np.flatnonzero(np.diff(place, prepend=-1))
            rows, columns, values = rows[first], columns[first], np.add.reduceat(values, first)
        return Csr(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=height))]), columns, values, width)

    @property
    def height(self) -> int:
        return len(self.bounds) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.height), np.diff(self.bounds))

    def transposed(self) -> Csr:
        return Csr.of(self.columns, self.rows(), self.width, self.height, self.values)

    def products(self, other: Csr, at_once: int = 1 << 22) -> Iterator[tuple[int, Csr]]:
        """(first row, part) of self x other by row products: a row of the result is the sum of the rows of `other`
        that its entries name, each times the entry. A part has the rows whose terms are `at_once` in number, or one row."""
        lengths = np.diff(other.bounds)[self.columns]
        terms = np.concatenate([[0], np.cumsum(lengths)])[self.bounds]
        row = 0
        while row < self.height:
            end = max(row + 1, int(np.searchsorted(terms, terms[row] + at_once, "right")) - 1)
            a, b = self.bounds[row], self.bounds[end]
            take = _gathered(other.bounds[self.columns[a:b]], lengths[a:b])
            owner = np.repeat(np.repeat(np.arange(end - row), np.diff(self.bounds[row:end + 1])), lengths[a:b])
            yield row, Csr.of(owner, other.columns[take], end - row, other.width, np.repeat(self.values[a:b], lengths[a:b]) * other.values[take])
            row = end
