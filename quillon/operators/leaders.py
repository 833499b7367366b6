"""Sums of weights per row and query in numpy, of which each part of a table moves on only the best rows of every query."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd

CELLS = 2_000_000  # of rows times queries, and of single weights, at once


class Weights:
    """Weights of features (terms, phrases) in queries: (feature, query, weight), features and queries numbered."""

    def __init__(self, features: np.ndarray, queries: np.ndarray, weights: np.ndarray, n_features: int, n_queries: int):
        order = np.argsort(features, kind="stable")
        self.query, self.weight, self.width = queries[order], weights[order], n_queries
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(features, minlength=n_features))])

    def sums(self, rows: np.ndarray, features: np.ndarray, gains: np.ndarray | None, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, sums by row and query) in slices of the n rows. rows must rise; a weight counts times its gain."""
        size = self.begin[features + 1] - self.begin[features]
        step = max(1, CELLS // max(self.width, 1))
        for first in range(0, n, step):
            a, b = np.searchsorted(rows, [first, first + step])
            last = min(step, n - first)
            out = np.zeros(last * self.width)
            while a < b:  # a row of many features is taken in parts
                c = min(b, a + max(1, int(np.searchsorted(np.cumsum(size[a:b]), CELLS))))
                own = size[a:c]
                total = int(own.sum())
                at = np.repeat(self.begin[features[a:c]] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(total)
                value = self.weight[at] if gains is None else self.weight[at] * np.repeat(gains[a:c], own)
                out += np.bincount(np.repeat(rows[a:c] - first, own) * self.width + self.query[at], value, len(out))
                a = c
            yield first, out.reshape(last, self.width)


class Leaders:
    """The k best ids of each query by sums rounded to `places`; of equal ones the smallest. An id that comes again, as another
    segment, counts with its best sum, of equal ones with the smallest ordinal."""

    def __init__(self, queries: int, k: int, places: int):
        self.k, self.places = k, places
        self.floor = np.zeros(queries)
        self.held: list[pd.DataFrame] = []
        self.size, self.bound = 0, max(20_000, 4 * queries * k)

    def add(self, sums: np.ndarray, ids: Sequence, ordinals: Sequence | None = None) -> None:
        """sums: by row and query; what is not above 0 does not count."""
        row, query = np.nonzero((sums >= self.floor - 2 * 10.0**-self.places) & (sums > 0))
        if not len(row):
            return
        own = sums[row, query]
        taken = pd.DataFrame({"query": query, "id": np.asarray(ids, object)[row], "sum": own, "score": np.round(own, self.places), "ordinal": 0 if ordinals is None else np.asarray(ordinals)[row]})
        self.held.append(taken)
        self.size += len(taken)
        if self.size > self.bound or (self.floor == 0).all():
            self.cut()

    def cut(self) -> pd.DataFrame | None:
        if not self.held:
            return None
        every = pd.concat(self.held, ignore_index=True).sort_values(["query", "id", "sum", "ordinal"], ascending=[True, True, False, True]).drop_duplicates(["query", "id"])
        best = every.sort_values(["query", "score", "id"], ascending=[True, False, True]).groupby("query", sort=False).head(self.k)
        full = best.groupby("query")["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.floor[full.index.to_numpy()] = full["min"].to_numpy()
        self.held, self.size = [best], len(best)
        self.bound = max(self.bound, 2 * self.size)
        return best
