"""Deep-shallow string sorting: multikey quicksort to a small depth, blind tries for what is equal up to there."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SHALLOW = 32
STEP = 8


class Block:
    """Byte strings in one buffer, to be read eight bytes at a time."""

    def __init__(self, strings: Sequence[bytes]):
        self.strings = strings
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)][:-1]
        self.data = np.frombuffer(b"".join(strings) + bytes(STEP), np.uint8)

    def keys(self, which: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The eight bytes from ``depth`` on as one number, bytes past the end as zero."""
        left = np.clip(self.lengths[which] - depth, 0, STEP)
        at = np.minimum(self.starts[which] + depth, len(self.data) - STEP)
        key = np.zeros(len(which), np.uint64)
        for i in range(STEP):
            key = (key << np.uint64(8)) | np.where(i < left, self.data[at + i], 0).astype(np.uint64)
        return key


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class BlindTrie:
    """Branches carry a depth and the byte there; all other bytes are looked up in one leaf at insertion."""

    def __init__(self, strings: Sequence[bytes], first: int):
        self.strings, self.root = strings, [first]

    def _byte(self, s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def add(self, which: int) -> None:
        s, node = self.strings[which], self.root
        while isinstance(node, tuple):
            depth, branches = node
            node = branches.get(self._byte(s, depth)) or next(iter(branches.values()))
        other = self.strings[node[0]]
        if other == s:
            node.append(which)
            return
        depth = common_prefix(s, other)
        above, node, byte = None, self.root, 0
        while isinstance(node, tuple) and node[0] < depth:
            above, byte = node, self._byte(s, node[0])
            node = node[1].get(byte)
        if isinstance(node, tuple) and node[0] == depth:
            node[1][self._byte(s, depth)] = [which]
            return
        fork = (depth, {self._byte(s, depth): [which], self._byte(other, depth): node})
        if above is None:
            self.root = fork
        else:
            above[1][byte] = fork

    def in_order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.extend(node)
        return out


def deep_shallow_sort(strings: Sequence[bytes], shallow: int = SHALLOW) -> np.ndarray:
    """Indices of the strings in byte order; equal strings in any order.

    The quicksort splits every open group at once into the parts below, at and above its pivot; the middle part goes
    on eight bytes further. Groups that are still equal at ``shallow`` bytes are ordered by a blind trie each.
    """
    block, order = Block(strings), np.arange(len(strings))
    lo, hi, depth = (np.array([x][: len(strings)], np.int64) for x in (0, len(strings), 0))
    deep: list[tuple[int, int]] = []
    while len(lo):
        sizes = hi - lo
        group = np.repeat(np.arange(len(lo)), sizes)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)
        which = order[at]
        key = block.keys(which, np.repeat(depth, sizes))
        begins = np.cumsum(sizes) - sizes
        three = np.sort(np.stack([key[begins], key[begins + sizes // 2], key[begins + sizes - 1]]), axis=0)
        pivot = np.repeat(three[1], sizes)
        part = group * 3 + (key >= pivot) + (key > pivot)
        order[at] = which[np.argsort(part, kind="stable")]
        counts = np.bincount(part, minlength=3 * len(lo))
        ends = np.repeat(lo - begins, 3) + np.cumsum(counts)
        starts, depths = ends - counts, np.repeat(depth, 3)
        depths[1::3] += STEP
        middle = np.zeros(len(starts), bool)
        middle[1::3] = depths[1::3] >= shallow
        large = counts > 1
        deep.extend(zip(starts[large & middle].tolist(), ends[large & middle].tolist(), strict=True))
        keep = large & ~middle
        lo, hi, depth = starts[keep], ends[keep], depths[keep]
    for a, b in deep:
        group = order[a:b].tolist()
        trie = BlindTrie(strings, group[0])
        for which in group[1:]:
            trie.add(which)
        order[a:b] = trie.in_order()
    return order


def neighbour_prefixes(strings: Sequence[bytes], order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each string in ``order`` with the one before it; 0 for the first."""
    block = Block(strings)
    out = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    most = np.minimum(block.lengths[order[:-1]], block.lengths[order[1:]]) if len(order) else out
    while len(open_):
        depth = out[open_]
        a, b = block.keys(order[open_ - 1], depth), block.keys(order[open_], depth)
        differ = a ^ b
        equal = np.full(len(open_), STEP)
        for i in range(STEP - 1, -1, -1):
            equal[(differ >> np.uint64(8 * (STEP - 1 - i))) & np.uint64(255) != 0] = i
        out[open_] = np.minimum(depth + equal, most[open_ - 1])
        open_ = open_[(equal == STEP) & (out[open_] < most[open_ - 1])]
    return out
