"""Numerical solvers that run on one group at a time (NumPy only)."""

from __future__ import annotations

import heapq

import numpy as np


class IndefiniteError(ValueError):
    """A matrix that should be positive definite is not."""


class NumericalError(ArithmeticError):
    """A step left the finite numbers."""


class SplitError(ValueError):
    """No split meets the size limits."""


def spd_power(a: np.ndarray, power: float, rcond: float = 1e-10) -> np.ndarray:
    """Power of a symmetric matrix on the eigenvalues above rcond times the largest."""
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    if not values[-1] > 0:
        raise IndefiniteError("no positive eigenvalue")
    good = values > rcond * values[-1]
    return (vectors[:, good] * values[good] ** power) @ vectors[:, good].T


def nystrom(ab: np.ndarray, n_vectors: int = 2, ridge: float = 1e-10) -> np.ndarray:
    """Normalised-cut embedding of n sampled and m other points from their n x (n + m) similarities."""
    n = len(ab)
    if not n_vectors < n:
        raise ValueError("more vectors than sampled points")
    a, b = ab[:, :n] + ridge * np.eye(n), ab[:, n:]
    rest = b.sum(axis=1)
    d1 = a.sum(axis=1) + rest
    d2 = np.abs(b.sum(axis=0) + rest @ spd_power(a, -1.0) @ b)
    degree = np.concatenate([d1, d2])
    if not (degree > 0).all():
        raise NumericalError("a degree is not positive")
    h = degree**-0.5
    a, b = h[:n, None] * h[None, :n] * a, h[:n, None] * h[None, n:] * b
    root = spd_power(a, -0.5)
    rb = root @ b
    values, vectors = np.linalg.eigh(a + rb @ rb.T)
    top = np.argsort(-values)[: n_vectors + 1]
    if not (values[top] > 0).all():
        raise NumericalError("an eigenvalue is not positive")
    v = (vectors[:, top] / np.sqrt(values[top])).T @ root @ np.concatenate([a, b], axis=1)
    base = np.where(v[0] == 0, v[0].mean(), v[0])
    out = (v[1:] / base).T
    if not np.isfinite(out).all():
        raise NumericalError("the embedding is not finite")
    return out


def knn_graph(points: np.ndarray, k: int) -> list[np.ndarray]:
    """Symmetric lists of the k nearest points; ties by index. Distances are taken a block at a time."""
    n = len(points)
    k = min(k, n - 1)
    links: list[set] = [set() for _ in range(n)]
    for at in range(0, n, 512):
        d = ((points[at : at + 512, None, :] - points[None]) ** 2).sum(axis=2)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        for row, near in enumerate(np.argsort(d, axis=1, kind="stable")[:, :k]):
            for j in near:
                links[at + row].add(int(j))
                links[j].add(at + row)
    return [np.array(sorted(x), np.int64) for x in links]


def component_count(links: list[np.ndarray], members: np.ndarray) -> int:
    """Connected components of the graph induced on ``members``."""
    left, count = set(members.tolist()), 0
    while left:
        stack, count = [left.pop()], count + 1
        while stack:
            near = left.intersection(links[stack.pop()].tolist())
            left -= near
            stack.extend(near)
    return count


def candidate_thresholds(x: np.ndarray, n: int = 10, min_gap: float = 0.01) -> list[float]:
    """Order statistics at even steps from the tenth to the ninetieth percent; the first, and those well above the last kept."""
    out: list[float] = []
    for t in np.sort(x)[np.floor(np.linspace(0.1, 0.9, n) * (len(x) - 1)).astype(int)]:
        if not out or t - out[-1] > min_gap:
            out.append(float(t))
    return out


def two_means(x: np.ndarray, starts: int = 5, rounds: int = 100, seed: int = 0) -> np.ndarray | None:
    """0 or 1 for each row by the best of several two-means runs; None where all rows are alike."""
    if np.allclose(x, x[0]):
        return None
    rng, best = np.random.default_rng(seed), None
    for _ in range(starts):
        first = x[rng.integers(len(x))]
        far = ((x - first) ** 2).sum(axis=1)
        centres = np.stack([first, x[rng.choice(len(x), p=far / far.sum())]]) if far.sum() > 0 else None
        if centres is None:
            continue
        labels = None
        for _ in range(rounds):
            d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
            new = d.argmin(axis=1)
            if labels is not None and (new == labels).all() or len(np.unique(new)) < 2:
                break
            labels = new
            centres = np.stack([x[labels == k].mean(axis=0) for k in (0, 1)])
        if labels is not None:
            cost = float(((x - centres[labels]) ** 2).sum())
            if best is None or cost < best[0]:
                best = (cost, labels)
    return None if best is None else best[1]


def spectral_tree(embedding: np.ndarray, geometry: np.ndarray, min_leaf: int = 100, max_leaf: int = 2000, max_depth: int = 62, k_range: tuple[int, int] = (10, 100), method: str = "threshold") -> np.ndarray:
    """Heap-coded leaf of each point by best-first division of the embedding.

    With ``method`` kmeans a cluster is split by two-means on all columns; sides
    below ``min_leaf`` points are peeled off as outliers (leaf 0) until both are
    large enough, at most ``min_leaf`` points unless the split is forced.

    A cluster scores sqrt(1 / components) in the geometry graph. It is split at a
    threshold on one embedding column if both sides keep ``min_leaf`` points and
    the worse child beats it; the first cluster and those above ``max_leaf`` are
    split regardless, in halves where no threshold fits.
    """
    n = len(embedding)
    if n < 4:
        raise SplitError("too few points")
    min_leaf = max(1, n // 4) if n <= 4 * min_leaf else min_leaf
    span = np.ptp(embedding, axis=0)
    scaled = (embedding - embedding.min(axis=0)) / np.where(span > 0, span, 1)
    everyone = np.arange(n)
    centred = geometry - geometry.mean(axis=0)
    for k in range(k_range[0], k_range[1] + 1, 10):
        links = knn_graph(centred, k)
        if k >= n - 1 or component_count(links, everyone) == 1:
            break
    score = lambda members: np.sqrt(1 / component_count(links, members))

    def split(members, own, forced):
        best = None
        for column in range(scaled.shape[1]):
            x = scaled[members, column]
            for t in candidate_thresholds(x):
                left, right = members[x < t], members[x >= t]
                if min(len(left), len(right)) >= min_leaf:
                    found = min(score(left), score(right))
                    if (best is None and forced) or found > (own if best is None else best[0]):
                        best = (found, left, right)
            if best is not None and not forced:
                break
        if best is None and forced and len(members) >= 2 * min_leaf:
            order = members[np.argsort(scaled[members, 0], kind="stable")]
            best = (0.0, order[: len(order) // 2], order[len(order) // 2 :])
        return best

    peeled: list[np.ndarray] = []

    def split_means(members, own, forced):
        lost = 0
        while forced or lost < min_leaf:
            labels = two_means(scaled[members]) if len(members) > 1 else None
            if labels is None:
                return None
            left, right = members[labels == 0], members[labels == 1]
            if min(len(left), len(right)) >= min_leaf:
                found = min(score(left), score(right))
                return (found, left, right) if forced or found > own else None
            if max(len(left), len(right)) < min_leaf:
                return None
            small, members = (left, right) if len(left) < min_leaf else (right, left)
            peeled.append(small)
            lost += len(small)
        return None

    if method not in ("threshold", "kmeans"):
        raise ValueError(f"unknown method {method!r}")
    divide = split if method == "threshold" else split_means
    queue, leaves, serial = [(0.0, -n, 0, "1", everyone)], [], 1
    while queue:
        own, _, _, name, members = heapq.heappop(queue)
        clusters = len(queue) + len(leaves) + 1
        found = None
        if clusters < 2 or not (len(members) <= 2 * min_leaf or len(name) > max_depth):
            found = divide(members, own, clusters < 2 or len(members) > max_leaf)
        if found is None:
            leaves.append((name, members))
            continue
        for digit, part in zip("01", found[1:], strict=True):
            heapq.heappush(queue, (score(part), -len(part), serial, name + digit, part))
            serial += 1
    out = np.zeros(n, np.int64)
    for name, members in leaves:
        out[members] = int(name, 2)
    for members in peeled:
        out[members] = 0
    return out


def linear_svr(z: np.ndarray, y: np.ndarray, c: float = 1.0, eps: float = 0.1, rounds: int = 100) -> np.ndarray:
    """Weights of 1/2 |w|^2 + c * sum max(0, |w z - y| - eps)^2 by Newton steps with halving."""
    w = np.zeros(z.shape[1])

    def value(w):
        over = np.maximum(0, np.abs(z @ w - y) - eps)
        return 0.5 * w @ w + c * over @ over

    for _ in range(rounds):
        gap = z @ w - y
        active = np.abs(gap) > eps
        za, ga = z[active], gap[active]
        grad = w + 2 * c * za.T @ (ga - eps * np.sign(ga))
        if np.abs(grad).max(initial=0) < 1e-9:
            break
        # the Hessian is I + 2c Z'Z: solved in the smaller of the two dimensions
        if len(za) < z.shape[1]:
            inner = np.eye(len(za)) / (2 * c) + za @ za.T
            step = grad - za.T @ np.linalg.solve(inner, za @ grad) if len(za) else grad
        else:
            step = np.linalg.solve(np.eye(z.shape[1]) + 2 * c * za.T @ za, grad)
        size, now = 1.0, value(w)
        while value(w - size * step) > now and size > 1e-12:
            size /= 2
        w = w - size * step
    return w


def darwin(rows: np.ndarray) -> np.ndarray:
    """Rank pooling of an ordered T x d sequence, forward and reversed: 2d weights."""

    def one_way(x):
        mean = np.cumsum(x, axis=0) / np.arange(1, len(x) + 1)[:, None]
        z = np.sign(mean) * np.sqrt(np.abs(mean))
        norm = np.sqrt((z * z).sum(axis=1, keepdims=True))
        return linear_svr(z / np.where(norm > 0, norm, 1), np.arange(1, len(x) + 1, dtype=float))

    return np.concatenate([one_way(rows), one_way(rows[::-1])])


def kernel_svm(k: np.ndarray, y: np.ndarray, c: float, tol: float = 1e-7, rounds: int = 100_000) -> tuple[np.ndarray, float]:
    """Dual coefficients (signed) and bias; C weighted by n / (2 n_class). Maximal violating pairs."""
    n = len(y)
    bound = np.where(y > 0, c * n / (2 * max(1, (y > 0).sum())), c * n / (2 * max(1, (y < 0).sum())))
    alpha, grad = np.zeros(n), -np.ones(n)
    if (y > 0).all() or (y < 0).all():
        return alpha, float(y[0])
    q = k * np.outer(y, y)
    for _ in range(rounds):
        up = ((y > 0) & (alpha < bound)) | ((y < 0) & (alpha > 0))
        down = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < bound))
        score = -y * grad
        i = np.flatnonzero(up)[np.argmax(score[up])]
        j = np.flatnonzero(down)[np.argmin(score[down])]
        if score[i] - score[j] < tol:
            break
        curve = max(q[i, i] + q[j, j] - 2 * y[i] * y[j] * q[i, j], 1e-12)
        step = (score[i] - score[j]) / curve
        step = min(step, bound[i] - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else bound[j] - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        grad += step * (y[i] * q[:, i] - y[j] * q[:, j])
    score = -y * grad
    free = (alpha > 1e-12) & (alpha < bound - 1e-12)
    bias = score[free].mean() if free.any() else (score[up].max() + score[down].min()) / 2
    return alpha * y, float(bias)


def average_precision(y: np.ndarray, score: np.ndarray) -> float:
    """Step-wise average precision; equal scores share the last rank."""
    order = np.argsort(-score, kind="stable")
    y, score = y[order] > 0, score[order]
    last = np.concatenate([score[1:] != score[:-1], [True]])
    hits, ranks = np.cumsum(y)[last], np.flatnonzero(last) + 1
    gained = np.diff(np.concatenate([[0], hits]))
    return float((gained * hits / ranks).sum() / max(1, y.sum()))


def balanced_accuracy(y: np.ndarray, predicted: np.ndarray) -> float:
    """Mean of the true rates of both classes that occur."""
    rates = [(predicted[y == s] == s).mean() for s in (1, -1) if (y == s).any()]
    return float(np.mean(rates)) if rates else float("nan")


def shares(parts: np.ndarray, weights: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Posterior shares of the components of a diagonal mixture for each point."""
    log = np.log(weights) - 0.5 * (np.log(var).sum(axis=1) + (((parts[:, None, :] - mu[None]) ** 2) / var[None]).sum(axis=2))
    p = np.exp(log - log.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def diagonal_em(parts: np.ndarray, weights: np.ndarray, mu: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Sums (q, q x, q x^2) and log-likelihood of points under a diagonal mixture."""
    log = np.log(weights) - 0.5 * (np.log(2 * np.pi * var).sum(axis=1) + (((parts[:, None, :] - mu[None]) ** 2) / var[None]).sum(axis=2))
    most = log.max(axis=1, keepdims=True)
    p = np.exp(log - most)
    total = p.sum(axis=1, keepdims=True)
    q = p / total
    return q.sum(axis=0), q.T @ parts, q.T @ (parts * parts), float((most + np.log(total)).sum())
