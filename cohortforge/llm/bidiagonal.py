"""Right singular vectors of a small triangular matrix by the bidiagonal qd route.

Householder reflections make the matrix upper bidiagonal; the squares of its diagonals are the arrays q and e of the qd algorithms. dqds
(differential quotient-difference with shifts) finds the squared singular values from the smallest up, without subtractions but those of the
shifts. Each direction comes from a twisted factorisation of B'B - lambda: the stationary transform from the top meets the progressive one
from the bottom at the index where the pivot is smallest, which gives the vector without solving with a bad pivot. Values that
agree in their leading digits are a cluster; its later vectors are found by inverse iteration, kept orthogonal to the earlier ones.

All arrays have the matrix's dimension, not the data's. Rows and columns of zeros, repeated values and one-element matrices are allowed.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(np.float64).eps
#: Values nearer to each other than this share of their size are a cluster.
CLUSTER = 1e-3


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) of an upper bidiagonal B = U' r V for a square ``r``."""
    m = np.array(r, np.float64)
    n = len(m)
    v = np.eye(n)
    for k in range(n):
        _reflect(m[k:, k:], None)
        if k + 2 < n:
            _reflect(m[k:, k + 1:].T, v[:, k + 1:].T)
    return np.diagonal(m).copy(), np.diagonal(m, 1).copy(), v


def _reflect(m: np.ndarray, along: np.ndarray | None) -> None:
    """Make the first column of ``m`` zero below its first entry by a reflection, applied to ``along`` as well."""
    x = m[:, 0].copy()
    top = np.abs(x).max(initial=0.0)
    if top == 0 or not x[1:].any():
        return
    x /= top
    x[0] += math.copysign(math.sqrt(float(x @ x)), x[0])
    x /= math.sqrt(float(x @ x))
    for a in (m, along):
        if a is not None:
            a -= np.outer(2 * x, x @ a)
    m[1:, 0] = 0


def _shifted(q: list[float], e: list[float], s: float):
    """One dqds transform: new q, new e and the d's; None as soon as the shift proves too large."""
    d, qq, ee, ds = q[0] - s, [], [], []
    for i in range(len(e)):
        if d < 0 or d != d:
            return None
        ds.append(d)
        here = d + e[i]
        ratio = q[i + 1] / here if here > 0 else 0.0
        qq.append(here)
        ee.append(e[i] * ratio)
        d = (d * ratio if here > 0 else q[i + 1]) - s
    if d < 0 or d != d:
        return None
    return [*qq, d], ee, [*ds, d]


def _lower_bound(q: list[float], e: list[float]) -> float:
    """1 / trace of the inverse of B'B: at most the smallest value, and near it when that stands apart."""
    total, carried = 0.0, 0.0
    for i, x in enumerate(q):  # diagonal of the inverse of BB' from the columns of the inverse of B
        if x <= 0:
            return 0.0
        carried = 1 / x + (carried * e[i - 1] / x if i else 0.0)
        total += carried
    return 1 / total if math.isfinite(total) else 0.0


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squared singular values, largest first, of the bidiagonal matrix with squared diagonal ``q`` and squared superdiagonal ``e``."""
    out: list[float] = []
    todo = [(list(map(float, q)), list(map(float, e)), 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        if q and len(q) > 1 and q[0] < q[-1]:  # small values go to the end
            q, e = q[::-1], e[::-1]
        smallest = None
        for _ in range(40 * (len(q) + 1)):
            while len(q) > 1 and e[-1] <= EPS * EPS * (sigma + q[-1]):
                out.append(sigma + q.pop())
                e.pop()
            if len(q) <= 1:
                out.extend(sigma + x for x in q)
                break
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (sigma + min(q[i], q[i + 1]))), None)
            if cut is not None:
                todo += [(q[:cut + 1], e[:cut], sigma), (q[cut + 1:], e[cut + 1:], sigma)]
                break
            step, shift = None, 0.0
            if smallest is not None:  # the last d's say how far the smallest value is at most
                shift = 0.99 * smallest - math.sqrt(e[-1] * smallest) if e[-1] < smallest else 0.25 * smallest
                step = _shifted(q, e, shift) if shift > 0 else None
            if step is None:
                shift = _lower_bound(q, e) * (1 - 4 * EPS * len(q))
                step = _shifted(q, e, shift) if sigma + shift > sigma else None
            if step is None:
                shift, step = 0.0, _shifted(q, e, 0.0)
            q, e, ds = step
            smallest, sigma = min(ds), sigma + shift
        else:
            raise ArithmeticError("dqds did not settle")
    return sorted(out, reverse=True)


def _twisted(d: np.ndarray, l: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """Unit vector of LDL' for ``value`` and a correction to the value, from the twisted factorisation of LDL' - value."""
    n = len(d)
    tiny = EPS * EPS * max(abs(value), float(np.abs(d).max()), np.finfo(float).tiny)
    safe = lambda x: x if abs(x) > tiny else math.copysign(tiny, x)
    s, below = [-value], []
    for i in range(n - 1):  # stationary, from the top
        pivot = safe(d[i] + s[-1])
        below.append(d[i] * l[i] / pivot)
        s.append(below[-1] * l[i] * s[-1] - value)
    p, above = [d[-1] - value], []
    for i in range(n - 2, -1, -1):  # progressive, from the bottom
        pivot = safe(d[i] * l[i] * l[i] + p[-1])
        above.append(l[i] * d[i] / pivot)
        p.append(p[-1] * d[i] / pivot - value)
    p, above = p[::-1], above[::-1]
    twist = np.array(s) + np.array(p) + value
    k = int(np.argmin(np.abs(twist)))
    z = np.zeros(n)
    z[k] = 1
    for i in range(k - 1, -1, -1):
        z[i] = -below[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -above[i] * z[i]
    size = float(z @ z)
    return z / math.sqrt(size), float(twist[k]) / size


def _inverse_iteration(d: np.ndarray, l: np.ndarray, value: float, others: list[np.ndarray], seed: int) -> np.ndarray:
    n = len(d)
    tiny = EPS * max(abs(value), float(np.abs(d).max()))
    s, pivots, below = -value, [], []
    for i in range(n):
        pivot = d[i] + s
        pivots.append(pivot if abs(pivot) > tiny else math.copysign(tiny, pivot))
        if i + 1 < n:
            below.append(d[i] * l[i] / pivots[-1])
            s = below[-1] * l[i] * s - value
    z = np.random.default_rng(seed).standard_normal(n)
    for _ in range(5):
        for other in [*others, *others]:
            z -= (other @ z) * other
        z /= math.sqrt(float(z @ z))
        for i in range(n - 1):
            z[i + 1] -= below[i] * z[i]
        z /= pivots
        for i in range(n - 2, -1, -1):
            z[i] -= below[i] * z[i + 1]
        z /= np.abs(z).max()
    for other in [*others, *others]:
        z -= (other @ z) * other
    return z / math.sqrt(float(z @ z))


def _vectors(a: np.ndarray, b: np.ndarray, values: list[float], most: int) -> list[np.ndarray]:
    """Vectors of the first ``most`` values (largest first) of the unreduced B'B with diagonal ``a`` and superdiagonal ``b``."""
    d, l = a * a, b / a[:-1]
    out: list[np.ndarray] = []
    first = 0  # of the cluster
    for i, value in enumerate(values[:most]):
        if i and values[i - 1] - value > CLUSTER * abs(values[i - 1]):
            first = i
        if i == first:
            z, more = _twisted(d, l, value)
            for _ in range(2):
                better, rest = _twisted(d, l, value + more)
                if abs(rest) >= abs(more):
                    break
                z, more = better, more + rest
            out.append(z)
        else:
            out.append(_inverse_iteration(d, l, value, out[first:i], i))
    return out


def right_singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, unit right vectors as columns) of a square ``r``, largest first, ``most`` at most."""
    a, b, v = bidiagonalise(r)
    scale = float(max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0)))
    if scale == 0:
        return np.zeros(0), np.zeros((len(a), 0))
    a, b = a / scale, b / scale
    a = np.where(np.abs(a) < EPS * EPS, EPS * EPS, a)  # no pivot is zero
    ends = np.flatnonzero(np.abs(b) <= 0.25 * EPS * (np.abs(a[:-1]) + np.abs(a[1:]))) + 1
    found = []
    for x, y in zip([0, *ends], [*ends, len(a)]):  # blocks that nothing connects
        values = dqds(list(a[x:y] ** 2), list(b[x:y - 1] ** 2))
        for value, z in zip(values, _vectors(a[x:y], b[x:y - 1], values, most)):
            found.append((value, v[:, x:y] @ z))
    found.sort(key=lambda f: -f[0])
    found = found[:most]
    return np.array([f[0] for f in found]) * scale * scale, np.stack([f[1] for f in found], axis=1)
