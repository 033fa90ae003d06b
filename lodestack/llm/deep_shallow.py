"""Deep-shallow sorting of suffixes: multikey quicksort to a shallow depth, then blind tries.

The shallow sorter works on all groups of suffixes at once, eight bytes at a
time: each round splits every open group by the word of its middle suffix into
smaller, equal and larger ones, and only the equal part goes eight bytes
deeper. Groups that still agree at the shallow depth have long common prefixes. Members
that equal their group's first suffix are found for all groups at once; the
others of each group are ordered by a blind trie, which compares a new suffix
with a single one of those already there.
"""

from __future__ import annotations

import numpy as np

from lodestack.llm.blobs import groups_of

WORD = 8


class _Node:
    """An inner node: the first byte at which its suffixes differ, and a child for each value of it."""

    __slots__ = ("depth", "children")

    def __init__(self, depth: int, children: dict) -> None:
        self.depth, self.children = depth, children


class _Leaf:
    __slots__ = ("text", "members")

    def __init__(self, text: bytes, member: int) -> None:
        self.text, self.members = text, [member]


class BlindTrie:
    """Strings of one length in order; only places of difference are kept in inner nodes."""

    def __init__(self) -> None:
        self.root: _Node | _Leaf | None = None

    def add(self, text: bytes, member: int) -> None:
        node = self.root
        if node is None:
            self.root = _Leaf(text, member)
            return
        # blind search: only the bytes that inner nodes name are looked at
        while type(node) is _Node:
            children = node.children
            node = children.get(text[node.depth]) or next(iter(children.values()))
        if node.text == text:
            node.members.append(member)
            return
        other = node.text
        low = next(i for i, (a, b) in enumerate(zip(text, other)) if a != b)
        # the new leaf hangs where the path first goes deeper than the difference
        parent, node = None, self.root
        while type(node) is _Node and node.depth < low:
            parent, node = node, node.children[text[node.depth]]
        if type(node) is _Node and node.depth == low:
            node.children[text[low]] = _Leaf(text, member)
            return
        fork = _Node(low, {other[low]: node, text[low]: _Leaf(text, member)})
        if parent is None:
            self.root = fork
        else:
            parent.children[text[parent.depth]] = fork

    def leaves(self) -> list[list[int]]:
        """Members of each distinct string, in the strings' order."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if type(node) is _Leaf:
                out.append(node.members)
            else:
                stack.extend(node.children[b] for b in sorted(node.children, reverse=True))
        return out


def _like_first(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: np.ndarray, begins: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """Of all members of groups of at least ``WORD`` bytes, equal up to ``depth``: whether they equal their group's first in the rest too."""
    if not len(begins):
        return np.zeros(0, dtype=bool)
    member = order[np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)]
    first = np.repeat(order[begins], sizes)
    a, b, length = starts[member], starts[first], lengths[first]
    same = np.ones(len(member), dtype=bool)
    for at in range(depth, int(length.max()), WORD):
        # the last word may overlap the one before
        live = np.flatnonzero(same & (length > at))
        place = np.minimum(at, length[live] - WORD)
        same[live] = words[a[live] + place] == words[b[live] + place]
    return same


def sort_groups(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, groups: np.ndarray, shallow: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Order the suffixes ``raw[starts:starts + lengths]`` within groups and name equal ones.

    Suffixes of one group have one length. Returns the order and, for each
    suffix, the number of its class of equal suffixes; classes count upwards in
    the order. ``raw`` needs ``WORD`` bytes after the last suffix.
    """
    n = len(starts)
    order = np.argsort(groups, kind="stable")
    if not n:
        return order, np.zeros(0, dtype=np.int64)
    words = np.ndarray(len(raw) - WORD + 1, dtype=">u8", buffer=np.ascontiguousarray(raw).data, strides=(1,))
    cuts = groups_of(groups[order])
    begin, size = cuts[:-1], np.diff(cuts)
    # an open group: its first place in the order, size and depth
    open_begin, open_size = begin[size > 1], size[size > 1]
    open_depth = np.zeros(len(open_begin), dtype=np.int64)
    finished = [begin[size == 1]]  # places where a class begins
    deep: list[tuple[np.ndarray, np.ndarray]] = []
    while len(open_begin):
        length = lengths[order[open_begin]]
        done = open_depth >= length
        finished.append(open_begin[done])
        late = ~done & (open_depth >= shallow)
        deep.append((open_begin[late], open_size[late]))
        on = ~done & ~late
        open_begin, open_size, open_depth, length = open_begin[on], open_size[on], open_depth[on], length[on]
        if not len(open_begin):
            break
        group = np.repeat(np.arange(len(open_begin)), open_size)
        place = np.arange(len(group)) + np.repeat(open_begin - (np.cumsum(open_size) - open_size), open_size)
        member = order[place]
        word = words[starts[member] + open_depth[group]].astype(np.uint64)
        short = np.minimum(length - open_depth, WORD)[group]
        word >>= ((WORD - short) * 8).astype(np.uint64)
        base = np.cumsum(open_size) - open_size
        pivot = word[base + open_size // 2][group]
        mixed = np.logical_or.reduceat(word != pivot, base)
        # groups of one word stay as they are and go deeper
        whole_begin, whole_size, whole_depth = open_begin[~mixed], open_size[~mixed], open_depth[~mixed] + WORD
        split = mixed[group]
        group, place, word, pivot = group[split], place[split], word[split], pivot[split]
        side = np.where(word == pivot, 1, np.where(word > pivot, 2, 0))
        key = group * 3 + side
        moved = np.argsort(key, kind="stable")
        order[place] = member[split][moved]
        cuts = groups_of(key[moved])
        first, size = cuts[:-1], np.diff(cuts)
        part = key[moved][first]
        begin, depth = place[first], open_depth[part // 3] + np.where(part % 3 == 1, WORD, 0)
        finished.append(begin[size == 1])
        more = size > 1
        open_begin, open_size, open_depth = (np.concatenate(x) for x in ((whole_begin, begin[more]), (whole_size, size[more]), (whole_depth, depth[more])))
    begins, sizes = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (list(zip(*deep)) or ([], [])))
    # most deep groups hold copies of one suffix: these are known without a trie, and so are a group's copies of its first one
    same = _like_first(words, starts, lengths, order, begins, sizes, shallow)
    copies = np.logical_and.reduceat(same, np.cumsum(sizes) - sizes) if len(begins) else np.zeros(0, dtype=bool)
    finished.append(begins[copies])
    edges = np.cumsum(sizes)
    data = raw.tobytes() if not copies.all() else b""
    for at, count, end in zip(begins[~copies].tolist(), sizes[~copies].tolist(), edges[~copies].tolist()):
        trie = BlindTrie()
        members = order[at : at + count]
        length = int(lengths[members[0]])
        known = same[end - count : end]
        lead, others = members[known], members[~known]
        for m, s in zip([int(lead[0]), *others.tolist()], (starts[[lead[0], *others]] + shallow).tolist()):
            trie.add(data[s : s + length - shallow], m)
        leaves = [lead.tolist() if x[0] == lead[0] else x for x in trie.leaves()]
        order[at : at + count] = [m for x in leaves for m in x]
        ends = np.cumsum([len(x) for x in leaves])
        finished.append(at + np.concatenate([[0], ends[:-1]]))
    new = np.zeros(n, dtype=np.int64)
    new[np.concatenate(finished)] = 1
    classes = np.empty(n, dtype=np.int64)
    classes[order] = np.cumsum(new) - 1
    return order, classes
