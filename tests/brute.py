"""Plain Python models the operators must equal."""

from __future__ import annotations

import numpy as np


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    scale = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / scale) if scale else 0.0


def leaders(rows: list[tuple[int, list[float]]], threshold: float) -> dict[int, int]:
    """Row id to id of the row that opened its cluster."""
    clusters: list[tuple[int, list[np.ndarray]]] = []
    placed = {}
    for row_id, values in sorted(rows, key=lambda r: r[0]):
        vector = np.asarray(values, dtype=float)
        best, best_similarity = None, -1.0
        for cluster in clusters:
            s = similarity(vector, np.mean(cluster[1], axis=0))
            if s >= threshold and s > best_similarity:
                best, best_similarity = cluster, s
        if best is None:
            best = (row_id, [])
            clusters.append(best)
        best[1].append(vector)
        placed[row_id] = best[0]
    return placed


def nearest(queries: dict[int, list[float]], items: dict[int, list[float]], k: int) -> dict[int, list[int]]:
    out = {}
    for q, vector in queries.items():
        ranked = sorted(
            (round(1 - similarity(np.asarray(vector), np.asarray(v)), 9), i) for i, v in items.items())
        out[q] = [i for _, i in ranked[:k]]
    return out


def planted(groups: int, rows: int, dimension: int, noise: float, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dimension))
    return centers[rng.integers(groups, size=rows)] + noise * rng.normal(size=(rows, dimension))
