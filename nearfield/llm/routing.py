"""Learned partitions of a vector space: a balanced neighbour graph and its classifier."""

from __future__ import annotations

import numpy as np


def nearest(queries: np.ndarray, base: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """Places of the ``k`` nearest rows of ``base`` for each query, nearest first."""
    out, norms = np.empty((len(queries), k), np.int64), (base**2).sum(1)
    for at in range(0, len(queries), block):
        d = norms - 2 * queries[at : at + block] @ base.T
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[at : at + block] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), 1), 1)
    return out


class LearnedPartitions:
    """Routes vectors to the most probable of ``2 ** depth`` partitions.

    ``fit`` takes a bounded sample, builds its neighbour graph and halves it again and
    again: within each part, values that start from the part's principal direction are
    averaged along the part's edges, which moves them towards the smoothest division of
    the graph, and the part is split at their median. So parts are balanced and cut few
    edges. The classifier is a tree of logistic gates, one per split, each fitted to
    tell the two halves apart; a partition's probability is the product of the gates on
    its way, and the most probable ones are found by a beam from the root. ``grown``
    puts routers fitted on the parts' own vectors below the parts of this one.
    """

    def __init__(self, depth: int):
        self.depth = depth

    def fit(self, sample: np.ndarray, neighbours: int = 8, smoothing: int = 12, steps: int = 6, ridge: float = 1e-2) -> LearnedPartitions:
        x = np.asarray(sample, np.float64)
        self.center = x.mean(0) if len(x) else np.zeros(x.shape[1])
        self.scale = np.maximum(x.std(0), 1e-9) if len(x) else np.ones(x.shape[1])
        self.gates = np.zeros((max(1, 2**self.depth - 1), x.shape[1] + 1), np.float32)
        if not self.depth or len(x) < 2:
            return self
        x = (x - self.center) / self.scale
        graph = nearest(x.astype(np.float32), x.astype(np.float32), min(neighbours + 1, len(x)))[:, 1:]
        part = np.zeros(len(x), np.int64)
        for level in range(self.depth):
            right = self._halve(x, graph, part, 2**level, smoothing)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(2**level + 1))
            for node in range(2**level):
                rows = order[bounds[node] : bounds[node + 1]]
                self.gates[2**level - 1 + node] = self._gate(x[rows], right[rows], steps, ridge)
            part = 2 * part + right
        return self

    def grown(self, below: dict[int, LearnedPartitions], levels: int) -> LearnedPartitions:
        """With ``levels`` more, the gates of a part's own router in the place of the part; a part without one stays even."""
        out = LearnedPartitions(self.depth + levels)
        out.center, out.scale = self.center, self.scale
        out.gates = np.zeros((2**out.depth - 1, self.gates.shape[1]), np.float32)
        out.gates[: 2**self.depth - 1] = self.gates[: 2**self.depth - 1]
        for part, router in below.items():
            # its gates read values centred and scaled by its own sample
            w = router.gates[:, :-1] * (self.scale / router.scale)
            b = router.gates[:, -1] + (router.gates[:, :-1] * ((self.center - router.center) / router.scale)).sum(1)
            for level in range(router.depth):
                to = 2 ** (self.depth + level) - 1 + part * 2**level
                some = slice(2**level - 1, 2 ** (level + 1) - 1)
                out.gates[to : to + 2**level] = np.column_stack([w[some], b[some]])
        return out

    @staticmethod
    def _halve(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, smoothing: int) -> np.ndarray:
        sizes = np.maximum(np.bincount(part, minlength=parts), 1)
        y = np.empty(len(x))
        by = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[by], np.arange(parts + 1))
        for node in range(parts):
            rows = by[bounds[node] : bounds[node + 1]]
            if len(rows):
                c = x[rows] - x[rows].mean(0)
                direction = np.linalg.eigh(c.T @ c)[1][:, -1]
                y[rows] = c @ (direction * np.sign(direction[np.abs(direction).argmax()]))
        same = part[graph] == part[:, None]
        degree = same.sum(1)
        for _ in range(smoothing):
            y = np.where(degree > 0, (y + (y[graph] * same).sum(1)) / (1 + degree), y)
            y -= (np.bincount(part, y, parts) / sizes)[part]
        order = np.lexsort((y, part))
        place = np.empty(len(x), np.int64)
        starts = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))[:-1]
        place[order] = np.arange(len(x)) - starts[part[order]]
        return (place >= (np.bincount(part, minlength=parts)[part] + 1) // 2).astype(np.int64)

    @staticmethod
    def _gate(x: np.ndarray, right: np.ndarray, steps: int, ridge: float) -> np.ndarray:
        a = np.hstack([x, np.ones((len(x), 1))])
        if not len(x):
            return np.zeros(a.shape[1])
        w = np.zeros(a.shape[1])
        penalty = ridge * max(1, len(x)) * np.eye(a.shape[1])
        penalty[-1, -1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w += np.linalg.solve((a * (p * (1 - p) + 1e-3)[:, None]).T @ a + penalty, a.T @ (right - p) - penalty @ w)
        return w

    def route(self, vectors: np.ndarray, probes: int, reach: float | None = None) -> np.ndarray:
        """The ``probes`` most probable partitions of each vector, best first; with 1 the one every gate finds more probable.

        With ``reach`` partitions that a gate keeps farther off than that are left out;
        their places hold -1.
        """
        n = len(vectors)
        beam, score = np.zeros((n, 1), np.int64), np.zeros((n, 1), np.float32)
        if not self.depth:
            return beam
        x = np.ones((n, self.gates.shape[1]), np.float32)
        x[:, :-1] = (np.asarray(vectors, np.float64) - self.center) / self.scale
        rows = np.arange(n)[:, None]
        if reach is not None:  # of a gate's value, what it grows by in one step straight through
            slope = np.linalg.norm(self.gates[:, :-1] / self.scale, axis=1)
            far = np.where(slope > 0, slope, np.inf) * (1.01 * reach) + 1e-4
        for level in range(self.depth):
            first = 2**level - 1
            if 2**level <= 8 * beam.shape[1]:  # few gates: all at once
                z = (x @ self.gates[first : first + 2**level].T)[rows, beam]
            else:
                z = np.einsum("nbd,nd->nb", self.gates[first + beam], x)
            soft = np.log1p(np.exp(-np.abs(z)))
            yes, no = score + np.minimum(z, 0) - soft, score - np.maximum(z, 0) - soft
            if reach is not None:
                bound = far[first + beam]
                yes, no = np.where(z < -bound, -np.inf, yes), np.where(z > bound, -np.inf, no)
            beam, score = np.hstack([2 * beam, 2 * beam + 1]), np.hstack([no, yes])
            if beam.shape[1] > probes:
                best = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
                beam, score = np.take_along_axis(beam, best, 1), np.take_along_axis(score, best, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        beam = np.take_along_axis(beam, order, 1)
        return beam if reach is None else np.where(np.isinf(np.take_along_axis(score, order, 1)), -1, beam)
