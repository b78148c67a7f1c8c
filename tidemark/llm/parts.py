"""Learned partitions of a bounded sample of vectors: neighbour graph, balanced cut, classifier.

All of it is matrix work on at most a few thousand rows; ``neighbours`` applies the result to every row.
"""

from __future__ import annotations

import numpy as np

# Fixed sizes of the learning: neighbours per vector in the graph, hidden units, passes, rows of a step.
GRAPH_NEIGHBOURS = 10
HIDDEN = 96
EPOCHS = 60
STEP_ROWS = 256
RATE = 0.004
# Rounds of refinement of one cut, and of smoothing before it.
CUT_ROUNDS = 24
SMOOTHING = 30


def nearest(queries: np.ndarray, vectors: np.ndarray, k: int, skip_self: bool = False) -> np.ndarray:
    """Row numbers of the ``k`` largest inner products of each query, in slices of bounded size."""
    k = min(k, len(vectors) - skip_self)
    out = np.zeros((len(queries), max(k, 0)), np.int64)
    for start in range(0, len(queries) if k > 0 else 0, 512):
        scores = queries[start : start + 512] @ vectors.T
        if skip_self:
            rows = np.arange(len(scores))
            scores[rows, rows + start] = -np.inf
        out[start : start + 512] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def graph(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the neighbour graph, each in both directions."""
    near = nearest(vectors, vectors, GRAPH_NEIGHBOURS, skip_self=True)
    a = np.repeat(np.arange(len(vectors)), near.shape[1])
    b = near.ravel()
    return np.concatenate([a, b]), np.concatenate([b, a])


def bisect(n: int, a: np.ndarray, b: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """Which of ``n`` nodes are on the left: exactly ``left`` of them, with few links cut.

    A random vector is smoothed over the links (its slowest part separates the graph) and cut at its
    rank; then nodes with the most to gain change sides in pairs as long as fewer links are cut.
    """
    degree = np.maximum(np.bincount(a, minlength=n), 1).astype(float)
    wave = rng.standard_normal(n)
    for _ in range(SMOOTHING):
        wave = 0.5 * wave + 0.5 * np.bincount(a, wave[b], minlength=n) / degree
        wave -= (wave * degree).sum() / degree.sum()
        wave /= np.abs(wave).max() or 1.0
    side = np.zeros(n, bool)
    side[np.argsort(wave, kind="stable")[:left]] = True
    best, least = side.copy(), int((side[a] != side[b]).sum())
    share = 0.1
    for _ in range(CUT_ROUNDS):
        apart = side[a] != side[b]
        gain = np.bincount(a, np.where(apart, 1.0, -1.0), minlength=n)
        inside, outside = np.flatnonzero(side), np.flatnonzero(~side)
        inside = inside[np.argsort(-gain[inside], kind="stable")]
        outside = outside[np.argsort(-gain[outside], kind="stable")]
        m = min(len(inside), len(outside), max(1, int(n * share)))
        worth = gain[inside[:m]] + gain[outside[:m]] > 0
        if not worth.any():
            break
        side[inside[:m][worth]] = False
        side[outside[:m][worth]] = True
        cut = int((side[a] != side[b]).sum())
        if cut < least:
            best, least = side.copy(), cut
        else:
            side, share = best.copy(), share / 2
    return best


def balanced_parts(vectors: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Part of every vector: the neighbour graph cut in two again and again; part sizes differ by rounding only."""
    rng = np.random.default_rng(seed)
    a, b = graph(vectors)
    out = np.zeros(len(vectors), np.int64)
    open_ = [(np.arange(len(vectors)), 0, parts)]
    while open_:
        nodes, first, count = open_.pop()
        if count == 1:
            out[nodes] = first
            continue
        place = np.full(len(vectors), -1)
        place[nodes] = np.arange(len(nodes))
        inner = (place[a] >= 0) & (place[b] >= 0)
        half = count // 2
        side = bisect(len(nodes), place[a[inner]], place[b[inner]], len(nodes) * half // count, rng)
        open_ += [(nodes[side], first, half), (nodes[~side], first + half, count - half)]
    return out


class Router:
    """A classifier with one hidden layer: the probability of every part, given a vector."""

    def __init__(self, dims: int, parts: int, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.scale = 1.0
        self.weights = [
            rng.standard_normal((dims, HIDDEN)) / np.sqrt(dims),
            np.zeros(HIDDEN),
            rng.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN),
            np.zeros(parts),
            np.zeros((dims, parts)),
        ]

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, shift, second, bias, direct = self.weights
        hidden = np.maximum(x @ first + shift, 0.0)
        scores = hidden @ second + x @ direct + bias
        scores -= scores.max(axis=1, keepdims=True)
        odds = np.exp(scores)
        return hidden, odds / odds.sum(axis=1, keepdims=True)

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        return self._forward(vectors * self.scale)[1]

    def fit(self, vectors: np.ndarray, wanted: np.ndarray, seed: int = 0) -> None:
        """Adam on the cross entropy with the shares of parts ``wanted`` of each vector."""
        rng = np.random.default_rng(seed)
        self.scale = np.sqrt(vectors.shape[1]) / max(float(np.sqrt((vectors**2).sum(axis=1).mean())), 1e-300)
        x = vectors * self.scale
        mean = [np.zeros_like(w) for w in self.weights]
        square = [np.zeros_like(w) for w in self.weights]
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(len(x))
            for start in range(0, len(x), STEP_ROWS):
                rows = order[start : start + STEP_ROWS]
                hidden, odds = self._forward(x[rows])
                wrong = (odds - wanted[rows]) / len(rows)
                back = (wrong @ self.weights[2].T) * (hidden > 0)
                slopes = [x[rows].T @ back, back.sum(0), hidden.T @ wrong, wrong.sum(0), x[rows].T @ wrong]
                step += 1
                for w, m, s, slope in zip(self.weights, mean, square, slopes, strict=True):
                    m += 0.1 * (slope - m)
                    s += 0.001 * (slope**2 - s)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


def shares(parts: np.ndarray, near: np.ndarray, count: int) -> np.ndarray:
    """Share of each part among a vector's neighbours."""
    out = np.zeros((len(near), count))
    np.add.at(out, (np.arange(len(near))[:, None], parts[near]), 1.0)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1.0)


def learn(vectors: np.ndarray, count: int, k: int, target: float) -> tuple[Router, int]:
    """A router to ``count`` parts and how many of the most probable parts a query has to look at.

    Every eighth vector is kept out of the learning; its ``k`` nearest of the others must lie in the parts
    looked at with a share of ``target``. ``k`` is what the wanted number of neighbours among all rows
    comes to in a sample of this size: those are about as near.
    """
    held = np.arange(len(vectors)) % 8 == 7
    known, asked = vectors[~held], vectors[held]
    count = max(1, min(count, len(known) // 8))
    router = Router(vectors.shape[1], count)
    if count == 1:
        return router, 1
    parts = balanced_parts(known, count)
    near = nearest(known, known, GRAPH_NEIGHBOURS, skip_self=True)
    router.fit(known, 0.5 * shares(parts, near, count) + 0.5 * np.eye(count)[parts])
    # Rows go where the router sends them, so that is where their neighbours are looked for.
    stored = router.probabilities(known).argmax(axis=1)
    ranks = np.argsort(np.argsort(-router.probabilities(asked), axis=1), axis=1)
    needed = np.take_along_axis(ranks, stored[nearest(asked, known, k)], axis=1)
    reached = [(needed < probes).mean() for probes in range(1, count + 1)]
    return router, int(np.argmax(np.array(reached) >= target)) + 1
