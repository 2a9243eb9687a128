"""A binary graphical model over trees of page nodes, with exact marginals by sum-product messages.

A node is content or not. Its own potential is the sum of the weights of its features; an edge's potential depends on the labels of parent and child and on
the edge's kind. Trees of many pages are one forest, and a message pass takes a step for each level of depth: upward each node sends its parent the
log-sum over its own label, downward each parent sends what it knows from elsewhere. Both passes together give the marginals of nodes and of
edges exactly, and these less the labels' own indicators are the gradient by which the weights are learned.
"""

from __future__ import annotations

import numpy as np

KINDS = 4


def depths(parent: np.ndarray) -> np.ndarray:
    """Each node's distance from its root, by pointer doubling: what a pointer skips is added as it doubles."""
    far, up = (parent >= 0).astype(np.int64), np.where(parent >= 0, parent, np.arange(len(parent)))
    while not np.array_equal(next_ := up[up], up):
        far, up = far + far[up], next_
    return far


class Forest:
    """Trees one after the other. parent: -1 at roots, else a node's place. kind: of the edge to the parent."""

    def __init__(self, parent: np.ndarray, kind: np.ndarray):
        self.parent, self.kind = parent, kind
        depth = depths(parent)
        order = np.lexsort((parent, depth))
        bounds = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 2))
        #: The nodes below the roots, level by level, those of one parent together; where each parent's begin, and the parents.
        self.levels = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            nodes = order[a:b]
            first = np.flatnonzero(np.diff(parent[nodes], prepend=-2))
            self.levels.append((nodes, first, parent[nodes][first]))

    def marginals(self, own: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(probability of label 1 of each node, joint of (parent's, own label) of each node that has a parent, log of the sum over all labellings).

        own: the potential of label 1 over label 0 of each node. edge: potentials by kind, parent's and own label.
        """
        n = len(self.parent)
        belief = np.stack([np.zeros(n), own], 1)
        message = np.zeros((n, 2))
        for nodes, first, ups in reversed(self.levels):
            x = edge[self.kind[nodes]] + belief[nodes][:, None, :]
            message[nodes] = np.logaddexp(x[:, :, 0], x[:, :, 1])
            belief[ups] += np.add.reduceat(message[nodes], first)
        roots = np.flatnonzero(self.parent < 0)
        total = float(np.logaddexp(belief[roots, 0], belief[roots, 1]).sum())
        joint = np.zeros((n, 2, 2))
        for nodes, _, _ in self.levels:
            up = self.parent[nodes]
            x = (belief[up] - message[nodes])[:, :, None] + edge[self.kind[nodes]] + (belief[nodes])[:, None, :]
            down = np.logaddexp(x[:, 0], x[:, 1])
            belief[nodes] = down
            x -= np.logaddexp(down[:, 0], down[:, 1])[:, None, None]
            joint[nodes] = np.exp(x)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), joint, total


class Features:
    """Lists of feature names as sparse rows. known: each name's column."""

    def __init__(self, rows: list[list[str]], known: dict[str, int]):
        self.size = len(known)
        lists = [[known[f] for f in row if f in known] for row in rows]
        self.node = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
        self.column = np.array([c for x in lists for c in x], np.int64)
        self.n = len(rows)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.node, weights[self.column], self.n)

    def summed(self, nodes: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, nodes[self.node], self.size)


class Model:
    """Weights of features, and edge potentials."""

    def __init__(self, weights: dict[str, float], edge: np.ndarray):
        self.weights, self.edge = weights, edge

    def content(self, rows: list[list[str]], forest: Forest) -> np.ndarray:
        """Each node's probability of being content."""
        get = self.weights.get
        own = np.fromiter((sum([get(f, 0.0) for f in row]) for row in rows), np.float64, len(rows))
        return forest.marginals(own, self.edge)[0]


def fit(rows: list[list[str]], forest: Forest, label: np.ndarray, least: int = 5, rounds: int = 120, step: float = 0.3, decay: float = 1e-4) -> Model:
    """Weights of greatest likelihood of the labels, less ``decay`` times their squares, by Adam over all trees at once. least: occurrences of a feature that has a weight."""
    found: dict[str, int] = {}
    for row in rows:
        for f in row:
            found[f] = found.get(f, 0) + 1
    known = {f: k for k, f in enumerate(sorted(f for f, c in found.items() if c >= least))}
    x = Features(rows, known)
    below = np.flatnonzero(forest.parent >= 0)
    place = (forest.kind[below], label[forest.parent[below]], label[below])
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, place, 1.0)
    wanted = x.summed(label.astype(np.float64))
    at = np.zeros(len(known) + KINDS * 4)
    mean, square = np.zeros_like(at), np.zeros_like(at)
    for t in range(1, rounds + 1):
        edge = at[len(known) :].reshape(KINDS, 2, 2)
        p, joint, _ = forest.marginals(x.times(at[: len(known)]), edge)
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, forest.kind[below], joint[below])
        slope = np.concatenate([wanted - x.summed(p), (seen - expected).ravel()]) / max(len(label), 1) - decay * at
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        at = at + step * (1 - t / (rounds + 1)) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return Model({f: float(at[k]) for f, k in known.items()}, at[len(known) :].reshape(KINDS, 2, 2))
