"""Splits and trees from sums per feature value: the part of tree growing that runs inside a task.

Features come as codes, places in a short list of cut points, so rows with equal codes are alike and are summed up first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

TIE = 1e-7  # gains closer than this share are equal
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values of a 64-bit mixing function


@dataclass(frozen=True)
class Growth:
    """How a tree is grown; ``features`` is how many a split may choose from, 0 for all."""

    max_depth: int = 30
    min_leaf: int = 1
    min_split: int = 2
    features: int = 0
    random_cuts: bool = False
    bootstrap: bool = False
    l2: float = 0.0
    seed: int = 42


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64 well mixed bits of each number: every draw below is a hash, so it does not depend on order or partitions."""
    z = np.asarray(x).astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def uniform(x: np.ndarray, salt: int) -> np.ndarray:
    return (mixed(x, salt) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def bootstrap_counts(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson with mean one, by the row's id."""
    steps = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, 1, 2, 3, 4, 5, 6, 7, 8]))
    return np.searchsorted(steps, uniform(ids, seed * 1_000_003 + tree), side="right").astype(np.float64)


@dataclass
class Tree:
    """Nodes in arrays: ``feature`` -1 is a leaf, ``left`` the first of two neighbouring children."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int16))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    n: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(0))
    path: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # names a node by its way from the root

    NAMES = ("feature", "cut", "left", "value", "n", "gain")

    def add(self, value: np.ndarray, n: np.ndarray, path: np.ndarray) -> np.ndarray:
        """New leaves; their numbers."""
        begin = len(self.feature)
        count = len(value)
        self.feature = np.r_[self.feature, np.full(count, -1, np.int16)]
        self.cut = np.r_[self.cut, np.zeros(count, np.uint8)]
        self.left = np.r_[self.left, np.full(count, -1, np.int32)]
        self.gain = np.r_[self.gain, np.zeros(count)]
        self.value, self.n = np.r_[self.value, value], np.r_[self.n, n.astype(np.int64)]
        self.path = np.r_[self.path, path]
        return np.arange(begin, begin + count)

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, sums: np.ndarray, left_sums: np.ndarray, l2: float) -> np.ndarray:
        """Give leaves two children each; the numbers of the left ones."""
        both = np.stack([left_sums, sums - left_sums], axis=2).reshape(len(sums), -1)  # left and right by turns
        paths = np.stack([mixed(self.path[nodes], 1), mixed(self.path[nodes], 2)], axis=1).ravel()
        children = self.add(both[2] / (both[1] + l2), both[0], paths)
        self.feature[nodes], self.cut[nodes], self.gain[nodes], self.left[nodes] = feature, cut, gain, children[::2]
        return children[::2]

    def descend(self, codes: np.ndarray, depths: tuple[int, ...] = (), min_split: int = 2) -> list[np.ndarray] | np.ndarray:
        """Node of each row; with ``depths``, its nodes no deeper than each of them, as if nodes under ``min_split`` rows had stayed whole."""
        node, met = np.zeros(len(codes), np.int64), []
        live, depth = np.arange(len(codes)), 0
        while True:
            if depth in depths:
                met.append(node.copy())
            here = node[live]
            live = live[(self.feature[here] >= 0) & (self.n[here] >= min_split)]
            if not len(live) or depths and depth >= max(depths):
                break
            here = node[live]
            node[live] = self.left[here] + (codes[live, self.feature[here]] > self.cut[here])
            depth += 1
        if not depths:
            return node
        return [*met, *[node] * (len(depths) - len(met))]


def best_cuts(seg: np.ndarray, code: np.ndarray, sums: np.ndarray, totals: np.ndarray, growth: Growth, values: np.ndarray,
              draw: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, cut and sums to the left of the best cut of one feature in each segment.

    Rows are sorted by segment and code; ``sums`` are their counts, weights and weighted labels, ``totals`` those of the
    segments.  ``draw`` holds a number in [0, 1) per segment where the cut is drawn between the least and largest value.
    """
    gains, cuts, lefts = np.full(totals.shape[1], -np.inf), np.zeros(totals.shape[1], np.int64), np.zeros_like(totals)
    heads = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    upto = np.cumsum(sums, axis=1)
    before = upto[:, heads] - sums[:, heads]
    if draw is None:
        edge = np.flatnonzero((seg[1:] == seg[:-1]) & (code[1:] != code[:-1]))
        k, at = seg[edge], (code[edge].astype(np.int64) + code[edge + 1] - 1) // 2
    else:
        low, high = code[heads], code[np.r_[heads[1:], len(seg)] - 1]
        at = np.searchsorted(values, values[low] + draw * (values[high] - values[low]), side="right") - 1
        k = np.flatnonzero(high > low)
        at = np.clip(at, low, high.astype(np.int64) - 1)[k]
        edge = np.searchsorted(seg * 256 + code, k * 256 + at, side="right") - 1
    if not len(k):
        return gains, cuts, lefts
    left = upto[:, edge] - before[:, k]
    whole = totals[:, k]
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[2] ** 2 / (left[1] + growth.l2) + right[2] ** 2 / (right[1] + growth.l2) - whole[2] ** 2 / (whole[1] + growth.l2)
    gain = np.where((left[0] >= growth.min_leaf) & (right[0] >= growth.min_leaf), gain, -np.inf)
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    best = np.maximum.reduceat(gain, starts)
    # the first of equals; sums in another order differ by rounding
    top = np.flatnonzero(gain >= np.repeat(best - TIE * np.abs(best), np.diff(np.r_[starts, len(k)])))
    top = top[np.r_[True, k[top][1:] != k[top][:-1]]]
    gains[k[top]], cuts[k[top]], lefts[:, k[top]] = gain[top], at[top], left[:, top]
    return gains, cuts, lefts


def chosen(growth: Growth, paths: np.ndarray, n_features: int) -> np.ndarray:
    """Which features each node may use."""
    if not growth.features or growth.features >= n_features:
        return np.ones((len(paths), n_features), bool)
    draws = np.stack([mixed(paths, 100 + f) for f in range(n_features)], axis=1)
    return draws.argsort(axis=1).argsort(axis=1) < growth.features


def best_splits(by_feature: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None], totals: np.ndarray, paths: np.ndarray, growth: Growth, values: list[np.ndarray],
                columns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1 for none), cut, gain and left sums for each segment; ``by_feature`` has (seg, code, sums) in order, or None for those ``columns`` leaves out."""
    may = chosen(growth, paths, len(by_feature))
    if columns is not None:
        may &= columns
    feature, cut, left = np.full(totals.shape[1], -1), np.zeros(totals.shape[1], np.int64), np.zeros_like(totals)
    # a gain within rounding of nothing is none
    gain = 1e-9 * np.abs(totals[2] ** 2 / np.maximum(totals[1], 1e-300)) + 1e-12
    for f, part in enumerate(by_feature):
        if columns is not None and not columns[f]:
            continue
        seg, code, sums = part
        g, c, s = best_cuts(seg, code, sums, totals, growth, values[f], uniform(paths, 200 + f) if growth.random_cuts else None)
        better = may[:, f] & (g > gain * (1 + TIE))
        feature[better], cut[better], gain[better], left[:, better] = f, c[better], g[better], s[:, better]
    return feature, cut, np.where(feature >= 0, gain, 0.0), left


def root_path(seed: int, tree: int) -> np.ndarray:
    return mixed(np.array([tree], np.uint64), seed)


def grow(codes: np.ndarray, sums: np.ndarray, growth: Growth, values: list[np.ndarray], path: np.ndarray, depth: int = 0, columns: np.ndarray | None = None) -> Tree:
    """A tree over cells (rows of ``codes`` with their ``sums``), all nodes of a level at a time."""
    tree = Tree()
    totals = sums.sum(axis=1, keepdims=True)
    open_nodes = tree.add(totals[2] / np.maximum(totals[1] + growth.l2, 1e-300), totals[0], path)
    place = np.where(sums[0] > 0, 0, -1)  # open node of each cell
    live = np.flatnonzero(place >= 0)
    used = np.flatnonzero(columns) if columns is not None else range(codes.shape[1])
    orders = {f: live[np.argsort(codes[live, f], kind="stable")] for f in used}
    while depth < growth.max_depth and len(open_nodes):
        wide = totals[0] >= max(2, growth.min_split, 2 * growth.min_leaf)
        by_feature = [(place[orders[f]], codes[orders[f], f], sums[:, orders[f]]) if f in orders else None for f in range(codes.shape[1])]
        feature, cut, gain, left = best_splits(by_feature, totals, tree.path[open_nodes], growth, values, columns)
        feature = np.where(wide, feature, -1)
        splits = np.flatnonzero(feature >= 0)
        if not len(splits):
            break
        first = tree.split(open_nodes[splits], feature[splits], cut[splits], gain[splits], totals[:, splits], left[:, splits], growth.l2)
        new_place = np.full(len(feature), -1)
        new_place[splits] = np.arange(len(splits)) * 2
        cells = np.flatnonzero(place >= 0)
        here = place[cells]
        right = codes[cells, np.maximum(feature[here], 0)] > cut[here]
        place[cells] = np.where(new_place[here] >= 0, new_place[here] + right, -1)
        open_nodes = np.stack([first, first + 1], axis=1).ravel()
        totals = np.stack([left[:, splits], totals[:, splits] - left[:, splits]], axis=2).reshape(3, -1)
        small = np.uint16 if len(open_nodes) < 1 << 16 else np.int64  # sorted in linear time
        for f, o in orders.items():
            o = o[place[o] >= 0]
            orders[f] = o[np.argsort(place[o].astype(small), kind="stable")]
        depth += 1
    return tree


def keys_of(codes: np.ndarray) -> np.ndarray:
    """A key for each row of codes, in the order of the rows: the first code counts most."""
    if codes.shape[1] > 8:
        return np.ascontiguousarray(codes).view(f"S{codes.shape[1]}").ravel()
    wide = np.zeros((len(codes), 8), np.uint8)
    wide[:, 8 - codes.shape[1]:] = codes
    return wide.view(">u8").ravel().astype(np.uint64)


def cells_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``codes`` and which of them each row is."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    if codes.shape[1] <= 8:
        _, first, which = np.unique(keys_of(codes), return_index=True, return_inverse=True)
        return codes[first], which
    order = np.lexsort(codes.T[::-1])
    ordered = codes[order]
    new = np.r_[True, (ordered[1:] != ordered[:-1]).any(axis=1)]
    which = np.empty(len(codes), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], which


def cell_sums(which: np.ndarray, n_cells: int, weights: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Rows of positive weight, weights and weighted labels per cell."""
    return np.stack([np.bincount(which, weights > 0, n_cells), np.bincount(which, weights, n_cells), np.bincount(which, weights * labels, n_cells)])
