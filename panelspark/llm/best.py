"""The k best rows of many queries at once, for use inside tasks."""

from __future__ import annotations

import numpy as np

LOWEST = -(2**63 - 1)
#: Stands for a missing id, which comes after all others.
NO_ID = 2**63 - 1


class Best:
    """For every query the ``k`` rows offered so far with the highest score, equal scores by smaller id.

    ``bar_score`` and ``bar_id`` keep out what is already known not to be among
    the best: a row must score more than the bar, or as much with a smaller id.
    """

    def __init__(self, bar_score: np.ndarray, bar_id: np.ndarray, k: int) -> None:
        n = len(bar_score)
        self.k = k
        self.scores = np.full((n, k), LOWEST, np.int64)
        self.ids = np.full((n, k), NO_ID, np.int64)
        self.marks = np.zeros((n, k), bool)
        self.bar_score = np.array(bar_score, np.int64)
        self.bar_id = np.array(bar_id, np.int64)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, marks: np.ndarray | None = None) -> None:
        """New candidates ``ids`` of the queries ``rows``, with one line of ``scores`` (and marks) per query."""
        bar = self.bar_score[rows][:, None]
        good = (scores > bar) | ((scores == bar) & (ids < self.bar_id[rows][:, None]))
        hit = good.any(axis=1)
        if not hit.any():
            return
        rows, good = rows[hit], good[hit]
        all_scores = np.concatenate([self.scores[rows], np.where(good, scores[hit], LOWEST)], axis=1)
        all_ids = np.concatenate([self.ids[rows], np.where(good, ids, NO_ID)], axis=1)
        order = np.lexsort((all_ids, -all_scores))[:, : self.k]
        self.scores[rows] = np.take_along_axis(all_scores, order, 1)
        self.ids[rows] = np.take_along_axis(all_ids, order, 1)
        if marks is not None:
            self.marks[rows] = np.take_along_axis(np.concatenate([self.marks[rows], good & marks[hit]], axis=1), order, 1)
        last, last_id = self.scores[rows, -1], self.ids[rows, -1]
        higher = (last > self.bar_score[rows]) | ((last == self.bar_score[rows]) & (last_id < self.bar_id[rows]))
        self.bar_score[rows[higher]], self.bar_id[rows[higher]] = last[higher], last_id[higher]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id, mark) of everything held."""
        query, place = np.nonzero(self.scores > LOWEST)
        return query, self.scores[query, place], self.ids[query, place], self.marks[query, place]
