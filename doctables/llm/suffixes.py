"""Ordering and repeat search over byte contexts, for one task's rows.

Deep-shallow sorting: multikey quicksort on the first bytes, then a blind trie for each group that
is still equal there. Contexts are rows of a byte matrix of one width, filled up with zeros.
"""

from __future__ import annotations

import numpy as np

# Bytes that the quicksort looks at, in words of eight; equal rows go on to a blind trie.
SHALLOW_WORDS = 2


def _shallow(rows: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Order by the first words, and the ranges of it that are equal in all of them."""
    words = np.ascontiguousarray(rows[:, : 8 * SHALLOW_WORDS]).view(">u8").astype(np.uint64)
    order = np.arange(len(rows))
    deep = []
    todo = [(0, len(rows), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2:
            continue
        if depth == SHALLOW_WORDS:
            deep.append((lo, hi))
            continue
        part = order[lo:hi]
        key = words[part, depth]
        if (key == key[0]).all():
            todo.append((lo, hi, depth + 1))
            continue
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        less, more = key < pivot, key > pivot
        a, b = int(less.sum()), int(more.sum())
        order[lo:hi] = np.concatenate([part[less], part[~less & ~more], part[more]])
        todo += [(lo, lo + a, depth), (lo + a, hi - b, depth + 1), (hi - b, hi, depth)]
    return order, deep


class _Node:
    """An inner node: the depth at which its strings first differ, and a child for each byte there."""

    __slots__ = ("depth", "children")

    def __init__(self, depth: int, children: dict) -> None:
        self.depth, self.children = depth, children


def _blind(strings: list[bytes]) -> list[int]:
    """Order of strings of one length by a blind trie; equal ones keep their order.

    A search compares no text on its way down, only the bytes at the nodes. It ends at a string that
    shares the longest prefix of all, and one comparison with that one tells where to insert.
    """
    width = len(strings[0])
    numbers = [int.from_bytes(s, "big") for s in strings]
    root: _Node | list[int] = [0]
    for i in range(1, len(strings)):
        s = strings[i]
        at = root
        while isinstance(at, _Node):
            at = at.children.get(s[at.depth]) or next(iter(at.children.values()))
        common = width - (((numbers[i] ^ numbers[at[0]]).bit_length() + 7) >> 3)
        if common == width:
            at.append(i)
            continue
        above, at = None, root
        while isinstance(at, _Node) and at.depth < common:
            above, at = at, at.children[s[at.depth]]
        if isinstance(at, _Node) and at.depth == common:
            at.children[s[common]] = [i]
            continue
        leaf = at
        while isinstance(leaf, _Node):
            leaf = next(iter(leaf.children.values()))
        node = _Node(common, {strings[leaf[0]][common]: at, s[common]: [i]})
        if above is None:
            root = node
        else:
            above.children[s[above.depth]] = node
    out: list[int] = []
    todo: list = [root]
    while todo:
        at = todo.pop()
        if isinstance(at, _Node):
            todo += [child for _, child in sorted(at.children.items(), reverse=True)]
        else:
            out += at
    return out


def deep_shallow(rows: np.ndarray) -> np.ndarray:
    """Indices of the rows in lexicographic order."""
    order, deep = _shallow(rows)
    for lo, hi in deep:
        part = order[lo:hi]
        order[lo:hi] = part[_blind([r.tobytes() for r in rows[part]])]
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each sorted row with the one before; 0 for the first."""
    out = np.zeros(len(order), dtype=np.int64)
    for lo in range(1, len(order), 8192):
        now = order[lo : lo + 8192]
        differ = rows[now] != rows[order[lo - 1 : lo - 1 + len(now)]]
        out[lo : lo + len(now)] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


class _Ranked:
    """Sorted rows, and for each row the longest prefix that it shares with any other."""

    def __init__(self, rows: np.ndarray) -> None:
        self.order = deep_shallow(rows)
        self.common = common_prefixes(rows, self.order)
        self.longest = np.empty(len(rows), dtype=np.int64)
        self.longest[self.order] = np.maximum(self.common, np.append(self.common[1:], 0))

    def classes(self, depth: int) -> np.ndarray:
        """Equal numbers for rows that agree in their first ``depth`` bytes."""
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = np.cumsum(self.common < depth)
        return out


def repeated_around(
    left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """How far repeated strings reach around anchors.

    An anchor has the bytes before it (``left``, nearest first) and those from it on (``right``),
    as wide as a repeated string is long. A string with ``a`` bytes before the anchor is repeated if
    another anchor agrees in ``a`` bytes to the left and in the rest to the right. Returns the least
    and the largest such ``a``, up to ``width - least``; -1 where there is none. All strings of one
    anchor contain its ``least`` bytes, so what they cover is one stretch.
    """
    width = right.shape[1]
    low = np.full(len(right), -1, dtype=np.int64)
    high = low.copy()
    if len(right) < 2:
        return low, high
    before, after = _Ranked(left), _Ranked(right)
    reach_left = np.minimum(before.longest, left_size)
    reach_right = np.minimum(after.longest, right_size)
    for a in range(width - least + 1):
        able = np.flatnonzero((reach_left >= a) & (reach_right >= width - a))
        if len(able) < 2:
            continue
        pair = before.classes(a)[able] * (len(right) + 1) + after.classes(width - a)[able]
        order = np.argsort(pair, kind="stable")
        sorted_pair = pair[order]
        same = sorted_pair[1:] == sorted_pair[:-1]
        twice = np.zeros(len(able), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = able[twice]
        low[hit] = np.where(low[hit] < 0, a, low[hit])
        high[hit] = a
    return low, high
