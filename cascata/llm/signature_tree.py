"""Signature trees over token sets, many at once, and their dual traversal.

A leaf holds a bitmap of one set's tokens and the set's size. An inner node holds the OR of the bitmaps below it, the range of
sizes, the most bit collisions of a leaf, and the range of labels. Of two nodes X and Y no pair below can share more than
popcount(X & Y) + min(collisions) tokens, nor more than the smaller of the largest sizes; where that is less than the least
sizes require for the wanted similarity, the pair of nodes is left. So is one whose leaves all carry one label.

Sizes fall into classes that span a factor of 4 / 3, so that similar sets are of one class or of neighbouring ones. A
block of sets has a tree for each class. A forest keeps the trees of many blocks in the same arrays, padded to one height,
so that small blocks cost array steps and not Python steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN_OUT = 8
#: Node pairs that one step evaluates take at most this many 64-bit words for each side.
STEP_WORDS = 1 << 19
#: Bitmaps that tell all shared tokens apart take at most so many bytes for the sets that are compared at once.
EXACT_BYTES = 64 << 20


def _classes() -> np.ndarray:
    """Least size of each class: sets of sizes n <= m with 4 n >= 3 m are of one class or of neighbouring ones."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append(4 * least[-1] // 3 + 1)
    return np.array(least, np.int64)


LEAST_OF_CLASS = _classes()


def size_class(n: np.ndarray | int) -> np.ndarray:
    return np.searchsorted(LEAST_OF_CLASS, n, "right") - 1


def width_of_class(c: np.ndarray | int) -> np.ndarray:
    """Bits of the bitmaps of a class: a power of two, 256 to 65536, at least twice the least size (and below 6 times)."""
    bits = np.ceil(np.log2(2.0 * LEAST_OF_CLASS[c])).astype(np.int64)
    return np.int64(1) << np.clip(bits, 8, 16)


def signature(tokens: np.ndarray) -> bytes:
    """The bitmap of a set of 64-bit hashes, as wide as its size class has it."""
    bits = np.zeros(int(width_of_class(size_class(len(tokens)))) if len(tokens) else 256, np.uint8)
    bits[tokens & np.uint64(len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Forest:
    """Trees over leaves that come sorted by tree. ``label`` may change between steps (``refresh``)."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, labels: np.ndarray, trees: np.ndarray, extra: np.ndarray | None = None):
        """trees: where each tree's leaves begin. extra: the most that a leaf's bitmap may count too little, by its size if not given."""
        self.labels = labels
        if extra is None:
            extra = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, extra)]
        self.child = [np.arange(len(sizes) + 1)]
        first, n = trees, np.diff(np.append(trees, len(sizes)))
        while (n > 1).any():
            up = -(-n // FAN_OUT)
            place = np.arange(up.sum()) - np.repeat(np.cumsum(up) - up, up)
            begin = np.repeat(first, up) + place * FAN_OUT
            bits, least, most, extra = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(bits, begin, axis=0), np.minimum.reduceat(least, begin), np.maximum.reduceat(most, begin), np.maximum.reduceat(extra, begin)))
            self.child.append(np.append(begin, len(least)))
            first, n = np.cumsum(up) - up, up
        self.refresh()

    def refresh(self) -> None:
        self.spread = [(self.labels, self.labels)]
        for child in self.child[1:]:
            low, high = self.spread[-1]
            self.spread.append((np.minimum.reduceat(low, child[:-1]), np.maximum.reduceat(high, child[:-1])))


def expand(child: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the node pairs (i, j); of a node with itself, each pair of children once."""
    left, right = child[i + 1] - child[i], child[j + 1] - child[j]
    n = left * right
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(right, n)
    u, v = np.repeat(child[i], n) + at // wide, np.repeat(child[j], n) + at % wide
    once = np.repeat(i != j, n) | (u <= v)
    return u[once], v[once]


def similar_leaves(forest: Forest, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves with different labels below the pairs of roots (i, j) that no bound rules out, for a Jaccard of 3/4.

    Depth first, from the left, and a bounded number of node pairs at a time. The caller may change labels between pairs.
    """
    at_once = max(1, STEP_WORDS // forest.levels[0][0].shape[1])
    top = len(forest.levels) - 1
    stack = [(top, i[a : a + at_once], j[a : a + at_once]) for a in range(0, len(i), at_once)][::-1]
    while stack:
        depth, i, j = stack.pop()
        bits, least, most, extra = forest.levels[depth]
        low, high = forest.spread[depth]
        one_label = (low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j])
        keep = ~one_label & (4 * most[i] >= 3 * least[j]) & (4 * most[j] >= 3 * least[i])
        if not depth:
            keep &= i != j
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        shared = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64) + np.minimum(extra[i], extra[j])
        shared = np.minimum(shared, np.minimum(most[i], most[j]))
        keep = 7 * shared >= 3 * (least[i] + least[j])
        i, j = i[keep], j[keep]
        if not depth:
            if len(i):
                yield i, j
            continue
        child = forest.child[depth]
        few = max(1, at_once // (FAN_OUT * FAN_OUT))
        stack += [(depth - 1, *expand(child, i[a : a + few], j[a : a + few])) for a in range(0, len(i), few)][::-1]


def hook(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join the labels of each pair (i, j) in place; returns the pairs that joined two labels, a forest."""
    took_i, took_j = [], []
    while True:
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        roots, at = np.unique(np.maximum(a, b), return_index=True)
        to = np.minimum(a, b)[at]
        took_i.append(i[at])
        took_j.append(j[at])
        parent = np.arange(len(labels))
        parent[roots] = to
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        labels[:] = parent[labels]
    none = np.zeros(0, np.int64)
    return (np.concatenate(took_i), np.concatenate(took_j)) if took_i else (none, none)


def _matrix(sigs, width: int) -> np.ndarray:
    """Bitmaps (a pyarrow binary array, all of one length) as rows of 64-bit words, folded to ``width`` bits."""
    _, offsets, data = sigs.buffers()
    at = np.frombuffer(offsets, np.int64 if str(sigs.type) == "large_binary" else np.int32)[sigs.offset : sigs.offset + len(sigs) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(len(sigs), -1).view(np.uint64)
    return raw if raw.shape[1] * 64 == width else np.bitwise_or.reduce(raw.reshape(len(sigs), -1, width // 64), axis=1)


def block_pairs(block: np.ndarray, side: np.ndarray, crossed: np.ndarray, size: np.ndarray, doc: np.ndarray, comp: np.ndarray, sigs, spanning: bool, of_comps: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of docs of one block that may be similar and are in different components, as arrays, a > b.

    Arrays have an entry per leaf: its block, its side (0 or 1) in a block whose pairs lie across two sides (``crossed``, by
    block), the set's size, doc, component, and its bitmap. ``spanning`` yields only pairs which join what no earlier pair
    of that block has joined; ``of_comps`` yields pairs of components, and only those which join what no earlier pair of any
    block here has joined.
    """
    kind = size_class(size)
    widths = width_of_class(kind)
    if of_comps:
        doc, spanning = comp, True
    for width in np.unique(widths).tolist():
        under = (kind > 0) & (width_of_class(np.maximum(kind - 1, 0)) == width)  # upper neighbours, with wider bitmaps
        here = np.flatnonzero((widths == width) | under)
        order = here[np.lexsort((doc[here], kind[here], side[here], block[here]))]
        key = (block[order] * 2 + side[order]) * 256 + kind[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        trees = key[first]
        own = widths[order][first] == width
        pairs_i, pairs_j = [], []

        def across(source: np.ndarray, wanted: np.ndarray) -> None:
            at = np.minimum(np.searchsorted(trees, wanted), len(trees) - 1)
            met = trees[at] == wanted
            pairs_i.append(source[met])
            pairs_j.append(at[met])

        index = np.arange(len(trees))
        of, flank = trees // 512, (trees // 256) % 2
        two = crossed[of]
        plain = index[own & ~two]
        across(plain, trees[plain])
        across(plain, trees[plain] + 1)
        left = index[own & two & (flank == 0)]
        across(left, trees[left] + 256)
        across(left, trees[left] + 257)
        right = index[own & two & (flank == 1)]
        across(right, trees[right] - 255)
        i, j = np.concatenate(pairs_i), np.concatenate(pairs_j)
        if not len(i):
            continue
        bits = np.empty((len(order), width // 64), np.uint64)
        for natural in np.unique(widths[order]).tolist():
            at = np.flatnonzero(widths[order] == natural)
            bits[at] = _matrix(sigs.take(order[at]), width)
        if spanning and not of_comps:  # labels stand for what has been joined so far, block by block
            labels = np.arange(len(order))
        else:
            labels = np.unique(comp[order], return_inverse=True)[1].astype(np.int64)
        forest = Forest(bits, size[order], labels, first)
        docs = doc[order]
        by_root = np.argsort(i, kind="stable")
        for a, b in similar_leaves(forest, i[by_root], j[by_root]):
            if spanning:
                a, b = hook(forest.labels, a, b)
                forest.refresh()
            differ = docs[a] != docs[b]
            yield np.maximum(docs[a[differ]], docs[b[differ]]), np.minimum(docs[a[differ]], docs[b[differ]])


def _exact_bits(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bitmaps, extra) of sets (sorted tokens, cut at ``bounds``): a bit for each token of two sets or more, or, where that
    takes more than ``EXACT_BYTES``, for several tokens; extra is what a bitmap then counts too little at most."""
    n = len(bounds) - 1
    _, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))[shared[place]]
    bit = number[place][shared[place]]
    words = max(1, -(-int(shared.sum()) // 64))
    most = max(4, EXACT_BYTES // (8 * n))
    if words > most:
        words = most
        bit = bit % (64 * words)
    at = row * words + (bit >> 6)
    if words == most:
        order = np.argsort(at, kind="stable")
        at, bit = at[order], bit[order]
    bits = np.zeros(n * words, np.uint64)
    if len(at):
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        bits[at[first]] = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), first)
    bits = bits.reshape(n, words)
    return bits, np.bincount(row, minlength=n) - np.bitwise_count(bits).sum(axis=1).astype(np.int64)


def linked_pairs(tokens: np.ndarray, bounds: np.ndarray, side: np.ndarray, doc: np.ndarray, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of docs whose whole sets are similar and that join two components not yet joined by an earlier pair.

    Every similar pair of different components is among what they join. Sets are sorted ``tokens`` cut at ``bounds``; where
    any side is 1, pairs lie across the sides.
    """
    size = np.diff(bounds)
    order = np.lexsort((size, comp, side))
    moved = np.repeat(bounds[:-1][order] - np.concatenate(([0], np.cumsum(size[order])))[:-1], size[order])
    tokens = tokens[moved + np.arange(len(tokens))]
    size, side, doc = size[order], side[order], doc[order]
    bounds = np.concatenate(([0], np.cumsum(size)))
    labels = np.unique(comp[order], return_inverse=True)[1].astype(np.int64)
    bits, extra = _exact_bits(tokens, bounds)
    trees = np.flatnonzero(np.concatenate(([True], side[1:] != side[:-1])))
    if side[-1] and len(trees) < 2:  # one side has no sets
        return
    forest = Forest(bits, size, labels, trees, extra)
    for i, j in similar_leaves(forest, np.array([0]), np.array([len(trees) - 1])):
        doubtful = np.flatnonzero((extra[i] > 0) & (extra[j] > 0))
        if len(doubtful):
            keep = np.ones(len(i), bool)
            for k in doubtful.tolist():
                x, y = (tokens[bounds[t[k]] : bounds[t[k] + 1]] for t in (i, j))
                keep[k] = 7 * len(np.intersect1d(x, y, assume_unique=True)) >= 3 * (len(x) + len(y))
            i, j = i[keep], j[keep]
        i, j = hook(forest.labels, i, j)
        forest.refresh()
        yield np.maximum(doc[i], doc[j]), np.minimum(doc[i], doc[j])
