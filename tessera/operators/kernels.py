"""NumPy kernels: plain functions, used in Arrow batches and tested without Spark."""

from __future__ import annotations

import heapq

import numpy as np


def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products along the last axis, summed from left to right as the SQL expression does."""
    out = np.zeros(np.broadcast_shapes(x.shape, y.shape)[:-1])
    for i in range(x.shape[-1]):
        out = out + x[..., i] * y[..., i]
    return out


def sums(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances along the last axis with the rounding of the Column expressions."""
    if metric == "ip":
        return -dot(x, y)
    if metric == "cosine":
        return -(dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y))))
    diff = x - y
    if metric in ("l2sqr", "l2"):
        return dot(diff, diff) if metric == "l2sqr" else np.sqrt(dot(diff, diff))
    if metric == "l1":
        return dot(np.abs(diff), np.ones(x.shape[-1]))
    if metric == "linf":
        return np.abs(diff).max(axis=-1)
    raise ValueError(f"unknown metric {metric}")


def block(queries: np.ndarray, points: np.ndarray, metric: str) -> np.ndarray:
    """Approximate distance matrix by one matrix product, where the metric allows it."""
    if metric in ("l1", "linf"):
        return np.stack([sums(q[None], points, metric) for q in queries]) if len(queries) else np.empty((0, len(points)))
    inner = queries @ points.T
    if metric == "ip":
        return -inner
    a, b = np.einsum("ij,ij->i", queries, queries), np.einsum("ij,ij->i", points, points)
    if metric == "cosine":
        return -inner / np.sqrt(np.maximum(np.outer(a, b), 1e-300))
    square = np.maximum(a[:, None] + b[None] - 2 * inner, 0)
    return np.sqrt(square) if metric == "l2" else square


def nearest(query_ids, queries, ids, points, k: int, metric: str, self_too: bool) -> list[tuple[int, int, float]]:
    """(query, id, distance) of the k best: chosen by the product with room for rounding, then measured exactly."""
    rough = block(queries, points, metric)
    if not self_too:
        rough[query_ids[:, None] == ids[None, :]] = np.inf
    out = []
    for row, q in enumerate(query_ids):
        far = rough[row]
        usable = np.isfinite(far)
        if not usable.any():
            continue
        kth = np.partition(far, min(k, usable.sum()) - 1)[min(k, usable.sum()) - 1]
        some = np.flatnonzero(far <= kth + 1e-9 * max(1.0, abs(kth)))
        exact = sums(points[some], queries[row][None], metric)
        for j in np.lexsort((ids[some], exact))[:k]:
            out.append((int(q), int(ids[some[j]]), float(exact[j])))
    return out


def best_first(neighbours, points, query, entries, ef: int, distance, skip=None) -> tuple[list[tuple[float, int]], int]:
    """The ef best (distance, position) reached from the entries, and the distances computed.

    ``neighbours`` gives the positions next to a position; ``skip(position, worst)`` tells
    which need no distance.
    """
    seen, cost = set(), 0
    frontier: list[tuple[float, int]] = []
    best: list[tuple[float, int]] = []  # largest first, as (-distance, -position)

    def offer(some) -> None:
        nonlocal cost
        new = [p for p in dict.fromkeys(some) if p not in seen and not (skip and len(best) >= ef and skip(p, -best[0][0]))]
        seen.update(new)
        if not new:
            return
        cost += len(new)
        for d, p in zip(distance(points[new], query), new, strict=True):
            if len(best) < ef or (-d, -p) > best[0]:
                heapq.heappush(frontier, (d, p))
                heapq.heappush(best, (-d, -p))
                if len(best) > ef:
                    heapq.heappop(best)

    offer(entries)
    while frontier:
        d, p = heapq.heappop(frontier)
        if len(best) >= ef and d > -best[0][0]:
            break
        offer(neighbours(p))
    return sorted((-d, -p) for d, p in best), cost


def diverse(owner: np.ndarray, candidates: list[tuple[float, int]], vectors, limit: int, metric: str) -> list[tuple[float, int]]:
    """Candidates in order of (distance, id), each kept unless a kept one is nearer to it than the owner is."""
    kept: list[tuple[float, int]] = []
    for d, c in sorted(set(candidates)):
        if len(kept) == limit:
            break
        if not kept or (sums(np.stack([vectors[x] for _, x in kept]), vectors[c][None], metric) >= d).all():
            kept.append((d, c))
    return kept


def balanced_leaves(points: np.ndarray, rows: np.ndarray, limit: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Split by two random pivots into equal halves, the points dealt to the nearer pivot in turn, until a leaf holds at most ``limit``."""
    if len(rows) <= limit:
        return [rows]
    a, b = rng.choice(rows, 2, replace=False)
    lean = block(points[rows], points[[a]], "l2sqr")[:, 0] - block(points[rows], points[[b]], "l2sqr")[:, 0]
    order = rows[np.lexsort((rows, lean))]
    half = len(rows) // 2
    return balanced_leaves(points, order[:half], limit, rng) + balanced_leaves(points, order[half:], limit, rng)


def spanning_forest(points: np.ndarray, rows: np.ndarray, degree: int, metric: str) -> list[tuple[int, int, float]]:
    """Kruskal over the complete graph of the rows; an edge joins only ends that have fewer than ``degree`` edges."""
    far = block(points[rows], points[rows], metric)
    i, j = np.triu_indices(len(rows), 1)
    order = np.lexsort((j, i, far[i, j]))
    parent, used, out = list(range(len(rows))), [0] * len(rows), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for e in order:
        a, b = int(i[e]), int(j[e])
        if used[a] < degree and used[b] < degree and root(a) != root(b):
            parent[root(a)] = root(b)
            used[a] += 1
            used[b] += 1
            out.append((int(rows[a]), int(rows[b]), float(far[a, b])))
    return out
