"""NumPy helpers that run inside tasks on one Arrow batch at a time."""

from __future__ import annotations

import numpy as np

from rowquarry.operators.ranking import SCORE_DIGITS

MAX_CELLS = 1_000_000  # scores of 8 bytes that are ranked at once


class BestK:
    """The ``k`` best (score, id) pairs of each query over a run of document blocks.

    Ties in the rounded score go to the smaller document id, so the result does not depend
    on how documents fall into blocks.
    """

    def __init__(self, query_vectors: np.ndarray, k: int, max_cells: int = MAX_CELLS):
        self.queries = np.ascontiguousarray(query_vectors, dtype=np.float64)
        self.k = k
        self.block = max(1, max_cells // max(1, len(self.queries)))
        count = len(self.queries)
        self.owner = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.int64)
        self.scores = np.empty(0, dtype=np.float64)
        self.floor = np.full(count, -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for start in range(0, len(ids), self.block):
            self._add_block(ids[start : start + self.block], vectors[start : start + self.block])

    def _add_block(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.rank(ids, self.queries @ vectors.astype(np.float64).T)

    def rank(self, ids: np.ndarray, similarity: np.ndarray) -> None:
        """Take in the scores (queries, documents) of one block; -inf marks documents that do not count."""
        similarity = np.round(similarity, SCORE_DIGITS)
        floor = self.floor
        if similarity.shape[1] > self.k:
            kth = similarity.shape[1] - self.k
            floor = np.maximum(floor, np.partition(similarity, kth, axis=1)[:, kth])
        owner, position = np.nonzero((similarity >= floor[:, None]) & (similarity > -np.inf))
        self._merge(owner, ids[position], similarity[owner, position])

    def _merge(self, owner: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        owner = np.concatenate([self.owner, owner])
        ids = np.concatenate([self.ids, ids])
        scores = np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores, owner))
        owner, ids, scores = owner[order], ids[order], scores[order]
        first = np.searchsorted(owner, owner, side="left")
        place = np.arange(len(owner)) - first
        keep = place < self.k
        self.owner, self.ids, self.scores = owner[keep], ids[keep], scores[keep]
        full = place[keep] == self.k - 1
        self.floor[self.owner[full]] = self.scores[full]


def spread_picks(
    query: np.ndarray, candidates: np.ndarray, valid: np.ndarray, picks: np.ndarray, relevance_share: float
) -> np.ndarray:
    """Greedy diversified picks for a batch of questions at once.

    ``query`` is (Q, D), ``candidates`` (Q, C, D) in fused order, ``valid`` (Q, C) marks real
    candidates, ``picks`` (Q,) how many to take. Returns (Q, max picks) candidate positions,
    -1 where a question has no more. Each round takes the best of
    ``share * similarity to the question - (1 - share) * similarity to the closest pick``;
    the first round has no picks yet and goes by similarity alone. Ties go to the earlier candidate.
    """
    relevance = np.einsum("qd,qcd->qc", query, candidates)
    between = np.einsum("qcd,qed->qce", candidates, candidates)
    rows = np.arange(len(query))
    rounds = int(picks.max()) if len(picks) else 0
    chosen = np.full((len(query), rounds), -1, dtype=np.int64)
    open_ = valid.copy()
    closest = np.full(relevance.shape, -np.inf)
    for step in range(rounds):
        if step == 0:
            value = relevance
        else:
            value = relevance_share * relevance - (1 - relevance_share) * closest
        value = np.where(open_, np.round(value, SCORE_DIGITS), -np.inf)
        best = value.argmax(axis=1)
        take = open_.any(axis=1) & (step < picks)
        chosen[take, step] = best[take]
        open_[rows[take], best[take]] = False
        closest = np.where(take[:, None], np.maximum(closest, between[rows, best]), closest)
    return chosen


class BestWeighted:
    """The ``k`` best documents of each question, a document's score being the sum over its terms of what the term
    weighs for the question times what it adds in the document.

    ``cuts`` bounds each term's run in ``owner`` (questions) and ``weight``. Documents come in blocks whose score
    table has at most ``max_cells`` cells, of which a task holds a few copies.
    """

    def __init__(self, n_questions: int, cuts: np.ndarray, owner: np.ndarray, weight: np.ndarray, k: int, max_cells: int = MAX_CELLS):
        self.n, self.cuts, self.asked, self.weight = n_questions, cuts, owner, weight
        self.best = BestK(np.empty((n_questions, 0)), k)
        self.block = max(1, max_cells // max(1, n_questions))

    def add(self, ids: np.ndarray, offsets: np.ndarray, terms: np.ndarray, parts: np.ndarray, bounded: bool = False) -> None:
        """Documents ``ids``; document i has the entries ``offsets[i]`` to ``offsets[i + 1]`` of terms and parts.
        ``bounded`` first leaves out the questions whose best possible score in these documents is below their k-th."""
        cuts, asked, weight = self.cuts, self.asked, self.weight
        if bounded:
            cuts, asked, weight = self._open_questions(terms, parts)
            if not len(asked):
                return
        for low in range(0, len(ids), self.block):
            high = min(low + self.block, len(ids))
            scores = np.zeros((high - low, self.n))
            for row in range(low, high):
                held = slice(offsets[row], offsets[row + 1])
                first = cuts[terms[held]]
                size = cuts[terms[held] + 1] - first
                places = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                scores[row - low] = np.bincount(asked[places], weight[places] * np.repeat(parts[held], size), self.n)
            self.best.rank(ids[low:high], np.where(scores > 0, scores, -np.inf).T)

    def _open_questions(self, terms: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The weights without those of questions that cannot improve: the largest part of each term bounds a score."""
        largest = np.zeros(len(self.cuts) - 1)
        np.maximum.at(largest, terms, parts)
        per_weight = np.repeat(largest, np.diff(self.cuts))
        bound = np.bincount(self.asked, np.maximum(self.weight, 0) * per_weight, self.n)
        live = bound * (1 + 1e-9) + 1e-8 >= self.best.floor  # sums may differ in their last digits
        keep = live[self.asked]
        cuts = np.append(0, np.cumsum(keep))[self.cuts]
        return cuts, self.asked[keep], self.weight[keep]
