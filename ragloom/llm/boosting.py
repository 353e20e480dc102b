"""Gradient-boosted trees small enough to be a SQL expression.

Fitted with numpy on a bounded sample on the driver; `Trees.column` turns the ensemble into CASE WHEN,
so that scoring runs inside the engine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None
    value: float = 0.0


@dataclass
class Trees:
    names: list[str]
    base: float
    nodes: list[Node]
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.nodes:
            out += _apply(t, x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))

    def column(self, of) -> Column:
        """Calibrated probability; of(name) is the column of a feature."""
        total = F.lit(self.base)
        for t in self.nodes:
            total = total + _case(t, self.names, of)
        return 1 / (1 + F.exp(-(total * self.slope + self.shift)))


def _apply(t: Node, x: np.ndarray) -> np.ndarray:
    if t.left is None:
        return np.full(len(x), t.value)
    return np.where(x[:, t.feature] <= t.cut, _apply(t.left, x), _apply(t.right, x))


def _case(t: Node, names: list[str], of) -> Column:
    if t.left is None:
        return F.lit(float(t.value))
    return F.when(of(names[t.feature]) <= F.lit(float(t.cut)), _case(t.left, names, of)).otherwise(_case(t.right, names, of))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int, ridge: float) -> Node:
    leaf = Node(value=float(g.sum() / (h.sum() + ridge)))
    if depth == 0 or len(g) < 2 * least:
        return leaf
    best, at = 1e-6, None
    score = lambda a, b: a * a / (b + ridge)
    whole = score(g.sum(), h.sum())
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v, cg, ch = x[order, k], np.cumsum(g[order]), np.cumsum(h[order])
        ok = np.flatnonzero(v[1:] > v[:-1])
        ok = ok[(ok + 1 >= least) & (len(v) - ok - 1 >= least)]
        if len(ok):
            gain = score(cg[ok], ch[ok]) + score(cg[-1] - cg[ok], ch[-1] - ch[ok]) - whole
            j = int(gain.argmax())
            if gain[j] > best:
                best, at = gain[j], (k, (v[ok[j]] + v[ok[j] + 1]) / 2)
    if at is None:
        return leaf
    low = x[:, at[0]] <= at[1]
    return Node(at[0], float(at[1]), _grow(x[low], g[low], h[low], depth - 1, least, ridge), _grow(x[~low], g[~low], h[~low], depth - 1, least, ridge))


def fit_trees(x: np.ndarray, y: np.ndarray, names: list[str], rounds: int = 30, depth: int = 3, rate: float = 0.3, least: int = 8, ridge: float = 1.0, hold: np.ndarray | None = None) -> Trees:
    """Logistic boosting on the rows that are not in hold (each fourth by default); those calibrate the margin (Platt)."""
    hold = np.arange(len(y)) % 4 == 0 if hold is None else hold
    fx, fy = x[~hold], y[~hold].astype(float)
    share = np.clip(fy.mean(), 1e-3, 1 - 1e-3)
    out = Trees(names, float(np.log(share / (1 - share))), [])
    margin = np.full(len(fy), out.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        t = _grow(fx, fy - p, p * (1 - p), depth, least, ridge)
        _scale(t, rate)
        out.nodes.append(t)
        margin += _apply(t, fx)
    m, t = out.margin(x[hold]), y[hold].astype(float)
    for _ in range(200):
        p = 1 / (1 + np.exp(-(out.slope * m + out.shift)))
        g = np.array([((p - t) * m).mean() + 1e-3 * (out.slope - 1), (p - t).mean()])
        w = p * (1 - p)
        h = np.array([[(w * m * m).mean() + 1e-3, (w * m).mean()], [(w * m).mean(), w.mean() + 1e-6]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        out.slope, out.shift = float(out.slope - np.clip(step[0], -0.5, 0.5)), float(out.shift - np.clip(step[1], -0.5, 0.5))
    return out


def _scale(t: Node, rate: float) -> None:
    if t.left is None:
        t.value *= rate
    else:
        _scale(t.left, rate)
        _scale(t.right, rate)


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability at which selections reach the precision; 1 if none does."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ok = np.flatnonzero(right >= precision)
    return float(p[order[ok[-1]]]) if len(ok) else 1.0
