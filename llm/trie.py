"""A path-compressed trie over ordered integer sets, walked by many probe sets at once, in pieces of bounded size."""

from __future__ import annotations

import numpy as np

#: Tokens of a node: a longer path is a chain of nodes, so that a probe leaves it where the bound first fails.
EDGE = 64
#: Tokens that one step of the walk compares at once.
WALK = 1 << 20


class SetTrie:
    """Sets as rising token sequences; sets that begin alike share the nodes of what they have in common.

    tokens: one sorted integer array a set, over 0 .. vocabulary - 1. sizes: the whole sets' sizes,
    of which tokens may leave out elements that no other set holds.
    """

    def __init__(self, tokens: list[np.ndarray], sizes: np.ndarray):
        keys = [t.astype(">u4").tobytes() for t in tokens]
        order = sorted((i for i in range(len(tokens)) if len(tokens[i])), key=keys.__getitem__)
        self.sizes = sizes
        self.pool = np.concatenate([tokens[i] for i in order]) if order else np.zeros(0, np.int64)
        base = np.cumsum([0, *(len(tokens[i]) for i in order)])
        start, stop, least, most, rest, parent, ends = [0], [0], [0], [0], [0], [-1], [[]]
        stack = [(0, 0)]  # (node, depth at its end)
        for k, i in enumerate(order):
            own = tokens[i]
            if k:
                last = tokens[order[k - 1]]
                m = min(len(own), len(last))
                differs = np.flatnonzero(own[:m] != last[:m])
                common = int(differs[0]) if len(differs) else m
            else:
                common = 0
            below = -1
            while stack[-1][1] > common:
                below = stack.pop()[0]
            node, depth = stack[-1]
            if depth < common:  # cut the edge to below at depth common
                length = common - depth
                start.append(start[below])
                stop.append(start[below] + length)
                parent.append(node)
                ends.append([])
                start[below] += length
                parent[below] = node = len(start) - 1
                stack.append((node, common))
            if len(own) > common:
                start.append(int(base[k]) + common)
                stop.append(int(base[k + 1]))
                parent.append(node)
                ends.append([])
                node = len(start) - 1
                stack.append((node, len(own)))
            ends[node].append(i)
        for v in range(1, len(start)):
            while stop[v] - start[v] > EDGE:  # the node keeps the rest; what comes first is a node above it
                start.append(start[v])
                stop.append(start[v] + EDGE)
                parent.append(parent[v])
                ends.append([])
                start[v] += EDGE
                parent[v] = len(start) - 1
        n = len(start)
        self.start, self.stop = np.array(start), np.array(stop)
        parents = np.array(parent)
        # bounds of each subtree: sizes of its sets, and tokens that may still follow the node
        least, most, rest = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for v, docs in enumerate(ends):
            for i in docs:
                least[v], most[v] = min(least[v], sizes[i]), max(most[v], sizes[i])
        depth = np.zeros(n, np.int64)
        self.children_of = [[] for _ in range(n)]
        for v in range(1, n):
            self.children_of[parents[v]].append(v)
        walk = [0]
        for v in walk:
            walk.extend(self.children_of[v])
        for v in reversed(walk[1:]):
            p = parents[v]
            least[p], most[p] = min(least[p], least[v]), max(most[p], most[v])
            rest[p] = max(rest[p], rest[v] + self.stop[v] - self.start[v])
        self.least, self.most, self.rest = least, most, rest
        self.n_children = np.array([len(c) for c in self.children_of])
        self.child_base = np.cumsum([0, *self.n_children])
        self.children = np.array([c for cs in self.children_of for c in cs], np.int64)
        self.n_ends = np.array([len(e) for e in ends])
        self.end_base = np.cumsum([0, *self.n_ends])
        self.ends = np.array([i for e in ends for i in e], np.int64)

    def join(self, probes: list[np.ndarray], sizes: np.ndarray, vocabulary: int, part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
        """(probe, set) index pairs with whole * intersection >= part * union.

        All probes go down together. Each carries its overlap with the path so far; a subtree is left when the tokens that
        remain on either side can't reach the overlap that its smallest set needs, or when the sizes are too far apart.
        A step takes nodes of WALK tokens at most, so memory follows the pairs that are still alive, not their paths.
        """
        hit = np.zeros((len(probes), vocabulary), bool)
        for i, t in enumerate(probes):
            hit[i, t] = True
        upto = np.cumsum(hit, axis=1, dtype=np.int32)
        total = upto[:, -1] if vocabulary else np.zeros(len(probes), np.int32)
        first = self.children[: self.n_children[0]]
        p = np.repeat(np.arange(len(probes)), len(first))
        waiting = [(p, np.tile(first, len(probes)), np.zeros(len(p), np.int64))]
        found_p, found_s = [], []
        while waiting:
            p, v, overlap = waiting.pop()
            n = sizes[p]
            fits = (part * self.least[v] <= whole * n) & (whole * self.most[v] >= part * n)
            p, v, overlap, n = p[fits], v[fits], overlap[fits], n[fits]
            if not len(p):
                continue
            length = self.stop[v] - self.start[v]
            ends = np.cumsum(length)
            k = max(1, int(np.searchsorted(ends, WALK, "right")))
            if k < len(p):
                waiting.append((p[k:], v[k:], overlap[k:]))
                p, v, overlap, n, length, ends = p[:k], v[:k], overlap[:k], n[:k], length[:k], ends[:k]
            at = ends - length
            flat = np.arange(ends[-1]) + np.repeat(self.start[v] - at, length)
            overlap = overlap + np.add.reduceat(hit[np.repeat(p, length), self.pool[flat]], at, dtype=np.int64)
            left = total[p] - upto[p, self.pool[self.stop[v] - 1]]
            reach = overlap + np.minimum(left, self.rest[v])
            alive = (part + whole) * reach >= part * (n + self.least[v])
            p, v, overlap = p[alive], v[alive], overlap[alive]
            k = self.n_ends[v]
            if k.any():
                s = self.ends[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(self.end_base[v], k)]
                q, o = np.repeat(p, k), np.repeat(overlap, k)
                good = (part + whole) * o >= part * (sizes[q] + self.sizes[s])
                found_p.append(q[good])
                found_s.append(s[good])
            k = self.n_children[v]
            w = self.children[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(self.child_base[v], k)]
            if len(w):
                waiting.append((np.repeat(p, k), w, np.repeat(overlap, k)))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *found_p]), np.concatenate([none, *found_s])
