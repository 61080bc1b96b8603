"""Optimal transport between two small structures: Sinkhorn and entropic Gromov-Wasserstein."""

from __future__ import annotations

import numpy as np


def sinkhorn(cost: np.ndarray, p: np.ndarray, q: np.ndarray, reg: float = 0.05, rounds: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Plan with marginals ``p`` and ``q`` of least cost plus ``reg`` times negative entropy, in the log domain."""
    f, g = np.zeros_like(p), np.zeros_like(q)
    log_p, log_q = np.log(np.maximum(p, 1e-300)), np.log(np.maximum(q, 1e-300))

    def soft(m: np.ndarray, axis: int) -> np.ndarray:
        top = m.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(m - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for _ in range(rounds):
        f = reg * (log_p - soft((g[None, :] - cost) / reg, 1))
        g = reg * (log_q - soft((f[:, None] - cost) / reg, 0))
        plan = np.exp((f[:, None] + g[None, :] - cost) / reg)
        if np.abs(plan.sum(1) - p).max() < tolerance:
            break
    return plan


def gromov_wasserstein(c1: np.ndarray, c2: np.ndarray, p: np.ndarray, q: np.ndarray, reg: float = 0.05, rounds: int = 50) -> tuple[np.ndarray, float]:
    """(plan, cost) aligning two distance matrices under square loss."""
    plan = np.outer(p, q)
    constant = np.outer(c1**2 @ p, np.ones_like(q)) + np.outer(np.ones_like(p), c2**2 @ q)
    for _ in range(rounds):
        following = sinkhorn(constant - 2 * c1 @ plan @ c2.T, p, q, reg)
        moved, plan = np.abs(following - plan).max(), following
        if moved < 1e-9:
            break
    return plan, float(((constant - 2 * c1 @ plan @ c2.T) * plan).sum())


def fused_cost(lexical: np.ndarray, semantic: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    """Both costs scaled to [0, 1] and mixed."""
    scaled = [np.zeros_like(c) if np.ptp(c) == 0 else (c - c.min()) / np.ptp(c) for c in (lexical, semantic)]
    return alpha * scaled[0] + (1 - alpha) * scaled[1]


def plan_entropy(plan: np.ndarray) -> float:
    """Sum of mass times its logarithm, zero for zero mass."""
    return float((plan * np.log(np.where(plan > 0, plan, 1.0))).sum())


def entropic_bound(reg: float, *sizes: int) -> float:
    """How far the entropic plan may be from the best: twice the root of the regularisation times the log of the larger size."""
    return 2.0 * float(np.sqrt(reg * np.log(max(sizes))))


def jaccard_costs(left: list[set], right: list[set], kinds: tuple[list, list], apart: float = 10.0) -> np.ndarray:
    """One less the overlap of two sets of one kind, ``apart`` for different kinds."""
    costs = np.full((len(left), len(right)), apart)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            if kinds[0][i] == kinds[1][j]:
                costs[i, j] = 1.0 - (len(a & b) / len(a | b) if a | b else 0.0)
    return costs


def assign(costs: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, each row and column at most once; every one of the shorter side is used.

    Rows enter one by one along shortest augmenting paths with potentials.
    """
    turned = costs.shape[0] > costs.shape[1]
    c = costs.T if turned else costs
    n, m = c.shape
    high, low = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        dist, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, reach, column = row, 0.0, -1
        while True:
            step = reach + c[at] - high[at] - low
            better = ~done & (step < dist)
            dist[better], back[better] = step[better], column
            column = int(np.where(done, np.inf, dist).argmin())
            reach = dist[column]
            done[column] = True
            if owner[column] < 0:
                break
            at = owner[column]
        settled = done.copy()
        settled[column] = False
        high[row] += reach
        for j in np.flatnonzero(settled):
            high[owner[j]] += reach - dist[j]
            low[j] -= reach - dist[j]
        while column >= 0:
            before = back[column]
            owner[column] = owner[before] if before >= 0 else row
            column = before
    pairs = [(int(owner[j]), int(j)) for j in range(m) if owner[j] >= 0]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)
