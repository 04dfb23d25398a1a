"""A multiway tree of hyperplanes over vectors, searched for the best inner products within windows.

A node has several split points; each row belongs to the point that it is nearest to, which cuts the space
by the hyperplanes between the points. For every pair of a split point and a subtree the node keeps the range of
distances from the point to the subtree's rows. A query asks for the rows whose inner product with it lies in a
window, the largest first. With the norms of a subtree's rows the window becomes an annulus of distances around
the query; a subtree is left out when for some split point the triangle inequality keeps its range out of the
annulus. What the query has found so far narrows its windows. Leaves are scored row by row, exactly.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from reelstate.llm.vectors import products

#: Split points of a node, at most.
DEGREE = 16
#: Candidates for each split point.
CANDIDATES = 3
#: Distances are compared with this much room for rounding.
ROOM = 1e-6
NO_ID = np.iinfo(np.int64).max


def squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows).astype(np.float64)


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    gaps = squares(left)[:, None] + squares(right)[None, :] - 2.0 * products(left, right)
    return np.sqrt(np.maximum(gaps, 0.0))


@dataclass
class Node:
    """Split points and what is known of the subtree of each."""

    points: np.ndarray
    children: list  # a number: the node's; a leaf's number is given as -1 - number
    low: np.ndarray = field(init=False)
    high: np.ndarray = field(init=False)
    norms: np.ndarray = field(init=False)

    def __post_init__(self):
        many = len(self.points)
        self.low, self.high = np.full((many, many), np.inf), np.full((many, many), -np.inf)
        self.norms = np.stack([np.full(many, np.inf), np.full(many, -np.inf)])

    def take(self, child: int, far: np.ndarray, norms: np.ndarray) -> None:
        """Widen what is known of a subtree by rows: their distances to all points, their squared norms."""
        self.low[:, child] = np.minimum(self.low[:, child], far.min(0))
        self.high[:, child] = np.maximum(self.high[:, child], far.max(0))
        self.norms[0, child] = min(self.norms[0, child], norms.min())
        self.norms[1, child] = max(self.norms[1, child], norms.max())


@dataclass
class Tree:
    nodes: list[Node]
    leaves: list[np.ndarray]  # the rows of each leaf, by their number in what the tree was grown over

    def without_ranges(self) -> "Tree":
        """The same split points, with nothing known of the subtrees."""
        return Tree([Node(node.points, node.children) for node in self.nodes], [])

    def route(self, rows: np.ndarray, learn: bool = False) -> np.ndarray:
        """The leaf of each row; ``learn`` widens the nodes' ranges by the rows."""
        leaf = np.zeros(len(rows), dtype=np.int64)
        norms = squares(rows) if learn else None
        stack = [(0, np.arange(len(rows)))] if self.nodes else []
        while stack:
            number, own = stack.pop()
            node = self.nodes[number]
            far = distances(rows[own], node.points)
            nearest = far.argmin(1)
            for child, target in enumerate(node.children):
                inside = nearest == child
                if not inside.any():
                    continue
                if learn:
                    node.take(child, far[inside], norms[own[inside]])
                if target < 0:
                    leaf[own[inside]] = -1 - target
                else:
                    stack.append((target, own[inside]))
        return leaf


def split_points(rows: np.ndarray, degree: int) -> np.ndarray:
    """Rows far from one another, picked one by one among evenly spaced candidates."""
    spaced = np.linspace(0, len(rows) - 1, min(len(rows), CANDIDATES * degree)).astype(np.int64)
    candidates = rows[np.unique(spaced)]
    picked = [0]
    gap = distances(candidates, candidates[:1])[:, 0]
    while len(picked) < degree and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(candidates, candidates[picked[-1]][None])[:, 0])
    return candidates[picked]


def grow(rows: np.ndarray, leaf_rows: int, degree: int = DEGREE) -> Tree:
    """A tree over ``rows`` with leaves of at most ``leaf_rows``, or of rows that no points part."""
    tree, norms = Tree([], []), squares(rows)

    def leaf(own: np.ndarray) -> int:
        tree.leaves.append(own)
        return -len(tree.leaves)

    def plant(own: np.ndarray) -> int:
        points = split_points(rows[own], degree) if len(own) > leaf_rows else own[:1]
        if len(points) < 2:
            return leaf(own)
        node, number = Node(points, []), len(tree.nodes)
        tree.nodes.append(node)
        far = distances(rows[own], points)
        nearest = far.argmin(1)
        for child in range(len(points)):
            inside = nearest == child  # a point that is a row is nearest to itself: none is empty
            node.take(child, far[inside], norms[own[inside]])
            node.children.append(plant(own[inside]))
        return number

    if len(rows) and plant(np.arange(len(rows))) < 0:
        tree.nodes.clear()
    return tree


@dataclass
class Wanted:
    """Queries: for each some windows of scores, and the best rows found in each so far."""

    vectors: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    low: np.ndarray  # by query and window
    high: np.ndarray
    most: int
    same: bool  # rows of the query's label, or of other labels

    def __post_init__(self):
        self.norms = squares(self.vectors)
        self.score = np.full((*self.low.shape, self.most), -np.inf)
        self.found = np.full((*self.low.shape, self.most), NO_ID, dtype=np.int64)

    def floor(self) -> np.ndarray:
        """What a row must score at least, by query and window."""
        return np.maximum(self.low, self.score[:, :, -1])

    def offer(self, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Score rows for the queries numbered ``own``, and keep the best: high scores, then small ids."""
        scores = products(self.vectors[own], vectors)
        fits = (self.labels[own][:, None] == labels[None, :]) == self.same
        fits &= self.ids[own][:, None] != ids[None, :]
        floor = self.floor()[own]
        for window in range(self.low.shape[1]):
            inside = fits & (scores >= floor[:, window, None]) & (scores <= self.high[own, window, None])
            query, row = np.nonzero(inside)
            if not len(query):
                continue
            changed = np.unique(query)
            held = own[changed]
            who = np.concatenate([query, np.repeat(changed, self.most)])
            score = np.concatenate([scores[query, row], self.score[held, window].ravel()])
            found = np.concatenate([ids[row], self.found[held, window].ravel()])
            order = np.lexsort((found, -score, who))
            who, score, found = who[order], score[order], found[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            kept = rank < self.most
            self.score[own[who[kept]], window, rank[kept]] = score[kept]
            self.found[own[who[kept]], window, rank[kept]] = found[kept]

    def alive(self, own: np.ndarray, node: Node) -> np.ndarray:
        """Which subtrees of the node may hold a row for which query: a row for each of ``own``."""
        far = distances(self.vectors[own], node.points)[:, :, None]
        least = np.maximum(far - node.high[None], node.low[None] - far).max(1)[:, None, :]
        most = (far + node.high[None]).min(1)[:, None, :]
        norms = self.norms[own][:, None, None]
        outer = norms + node.norms[1] - 2.0 * self.floor()[own][:, :, None]
        inner = norms + node.norms[0] - 2.0 * self.high[own][:, :, None]
        room = ROOM * (1.0 + np.sqrt(norms))
        within = (outer >= -room) & (least <= np.sqrt(np.maximum(outer, 0.0)) + room)
        within &= most + room >= np.sqrt(np.maximum(inner, 0.0))
        open_ = (self.floor()[own] <= self.high[own])[:, :, None]
        return (within & open_).any(1)

    def leaves(self, tree: Tree) -> Iterator[tuple[int, np.ndarray]]:
        """The leaves that are not ruled out, each with its queries; windows may narrow on the way."""
        everyone = np.flatnonzero((self.floor() <= self.high).any(1))
        if not tree.nodes:
            yield 0, everyone
            return
        stack = [(0, everyone)]
        while stack:
            number, own = stack.pop()
            if not len(own):
                continue
            if number < 0:
                yield -1 - number, own
                continue
            node = tree.nodes[number]
            open_ = self.alive(own, node)
            stack += [(target, own[open_[:, child]]) for child, target in enumerate(node.children)]

    def search(self, tree: Tree, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Find the best rows of those that the tree was grown over."""
        for leaf, own in self.leaves(tree):
            rows = tree.leaves[leaf] if tree.leaves else np.arange(0)
            if len(rows):
                self.offer(own, vectors[rows], ids[rows], labels[rows])
