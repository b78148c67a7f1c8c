"""Eigenvectors of a symmetric matrix in an interval, by contour integration (FEAST).

The projector onto the eigenvectors with values in an interval is a contour integral of the resolvent.
Quadrature turns it into a few solves with complex shifts; Rayleigh-Ritz takes the components out of the
subspace, and counts of inertia tell how many there must be. The matrix has the size of a vector, so its
square is held by the driver whatever the number of rows.
"""

from __future__ import annotations

import numpy as np

# Points on the upper half of the contour, and rounds at most.
POINTS = 32
ROUNDS = 60
# Bisection steps that place an eigenvalue; gaps between values looked at below the last wanted one.
BISECTIONS = 50
GAPS = 8


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and next diagonal of a matrix with the same eigenvalues, by reflections."""
    rest = np.array(matrix, float)
    n = len(rest)
    for i in range(n - 2):
        v = rest[i + 1 :, i].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v /= length
        inner = rest[i + 1 :, i + 1 :]
        turned = inner @ v
        turned -= (v @ turned) * v
        rest[i + 1 :, i + 1 :] = inner - 2 * (np.outer(v, turned) + np.outer(turned, v))
        side = rest[i + 1 :, i] - 2 * (v @ rest[i + 1 :, i]) * v
        rest[i + 1 :, i] = rest[i, i + 1 :] = side
    return np.diag(rest).copy(), np.diag(rest, 1).copy()


def values_above(bands: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Number of eigenvalues above ``shift``: positive pivots of the shifted matrix, by Sylvester's law."""
    diagonal, off = bands
    least = np.finfo(float).eps * (np.abs(diagonal).max(initial=0.0) + np.abs(off).max(initial=0.0)) or 1e-300
    above, pivot, squares = 0, 1.0, (np.concatenate([[0.0], off]) ** 2).tolist()
    for entry, square in zip(diagonal.tolist(), squares, strict=True):
        pivot = entry - shift - square / pivot
        if abs(pivot) < least:
            pivot = -least
        above += pivot > 0
    return above


def _value(bands: tuple[np.ndarray, np.ndarray], number: int, low: float, high: float) -> float:
    """The eigenvalue that is ``number``-th from above, roughly: by bisection on counts."""
    for _ in range(BISECTIONS):
        middle = (low + high) / 2
        low, high = (middle, high) if values_above(bands, middle) >= number else (low, middle)
    return (low + high) / 2


def intervals(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals that hold the ``wanted`` largest eigenvalues, rising, and how many values each holds.

    The lowest one ends in the widest gap among the values just below the last wanted one. A gap wider than
    the values gathered so far starts a new interval, and an interval reaches no farther than its own
    width or half of the nearer gap, so that no value outside is near its contour.
    """
    bound = float(np.abs(matrix).sum(axis=1).max()) or 1.0
    high = 1.01 * bound
    bands = tridiagonal(matrix)
    last = min(len(matrix), wanted + GAPS)
    values = [_value(bands, number, -high, high) for number in range(1, last + 1)]
    values.append(-high if last == len(matrix) else values[-1])
    gaps = -np.diff(values)
    at = wanted - 1 + int(gaps[wanted - 1 :].argmax())
    if gaps[at] <= 1e-9 * bound:
        return [(-high, high, len(matrix))]
    groups = [[values[at]]]
    for value in values[:at][::-1]:
        if value - groups[-1][-1] > 2 * (groups[-1][-1] - groups[-1][0]) + 1e-9 * bound:
            groups.append([])
        groups[-1].append(value)
    out = []
    below = gaps[at]
    for i, group in enumerate(groups):
        above = groups[i + 1][0] - group[-1] if i + 1 < len(groups) else np.inf
        margin = max(group[-1] - group[0], min(below, above) / 2)
        low, top = group[0] - min(below / 2, margin), group[-1] + min(above / 2, margin)
        out.append((low, top, values_above(bands, low) - values_above(bands, top)))
        below = above
    if sum(count for _, _, count in out) != values_above(bands, (values[at] + values[at + 1]) / 2):
        raise ArithmeticError("an eigenvalue lies between the intervals")
    return out


def components_in(matrix: np.ndarray, low: float, high: float, count: int, seed: int) -> np.ndarray:
    """The ``count`` eigenvectors with values in an interval, as columns.

    Raises ``ArithmeticError`` if the components found are not as many as the inertia says.
    """
    n = len(matrix)
    size = min(n, 3 * count + 8)
    center, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = np.pi / 2 * (1 + nodes)
    scale = float(np.abs(matrix).sum(axis=1).max()) or 1.0
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, size)))[0]
    found, before = basis[:, :0], np.inf
    for _ in range(ROUNDS):
        projected = np.zeros_like(basis)
        for angle, weight in zip(angles, weights, strict=True):
            turn = radius * np.exp(1j * angle)
            solved = np.linalg.solve((center + turn) * np.eye(n) - matrix, basis.astype(complex))
            # Both halves of the contour: the lower one is the conjugate of the upper.
            projected += weight / 2 * (turn * solved).real
        frame = np.linalg.qr(projected)[0]
        reduced = frame.T @ matrix @ frame
        ritz, turned = np.linalg.eigh((reduced + reduced.T) / 2)
        basis = frame @ turned
        # A value inside that is no eigenvalue shows by what it leaves over.
        over = np.abs(matrix @ basis - basis * ritz).max(axis=0)
        real = (ritz > low) & (ritz <= high) & (over <= 1e-11 * scale)
        found, wrong = basis[:, real], over[real].max(initial=0.0)
        # Near the accuracy of doubles: go on as long as that still halves what is wrong.
        if found.shape[1] == count and wrong > before / 2:
            break
        before = wrong if found.shape[1] == count else np.inf
    if found.shape[1] != count:
        raise ArithmeticError(f"{found.shape[1]} components found in an interval, {count} counted")
    return found


def eigenpairs(matrix: np.ndarray, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    wanted = min(wanted, len(matrix))
    if wanted == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    parts = [components_in(matrix, *one, seed) for one in intervals(matrix, wanted) if one[2]]
    frame = np.linalg.qr(np.column_stack(parts))[0]
    reduced = frame.T @ matrix @ frame
    values, turned = np.linalg.eigh((reduced + reduced.T) / 2)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], (frame @ turned)[:, order]
