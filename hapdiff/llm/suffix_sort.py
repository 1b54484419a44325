"""Deep-shallow ordering of byte windows: multikey quicksort to a shallow depth, then blind tries for what is still tied.

Both stages work on whole arrays: every open group takes its next step at once, so a step costs a few passes over the open suffixes.
"""

from __future__ import annotations

import numpy as np

#: Bytes compared at a time, and the depth at which quicksort hands a group to a blind trie.
WORD, SHALLOW = 8, 32


def words_at(text: np.ndarray) -> np.ndarray:
    """For each place of text (uint8) its next WORD bytes as a number that orders as they do; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(WORD, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for j in range(WORD):
        out |= padded[j : j + len(text)] << np.uint64(8 * (WORD - 1 - j))
    return out


def _starts(group: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)


def _ternary(side: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The new place of each entry when its group (at first, of size) is split stably by side: 0, 1, 2."""
    out = np.empty(len(side), np.int64)
    at, of = first.copy(), np.repeat(np.arange(len(first)), size)
    for s in range(3):
        mine = side == s
        before = np.cumsum(mine) - mine
        own = np.flatnonzero(mine)
        out[own] = at[of[own]] + before[own] - before[first][of[own]]
        at = at + np.add.reduceat(mine, first) if len(first) else at
    return out


def quicksort(keys: np.ndarray, suffixes: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """suffixes in the order of their first `depth` bytes, and for each place whether it begins a group of equal ones.

    Multikey quicksort over words: a group is split by its pivot's word; what equals it goes on with the next word.
    """
    order, begins = suffixes.copy(), np.zeros(len(suffixes), bool)
    if len(begins):
        begins[0] = True
    first, size, deep = np.zeros(min(1, len(order)), np.int64), np.array([len(order)][: len(order)], np.int64), np.zeros(min(1, len(order)), np.int64)
    while len(first):
        open_ = (size > 1) & (deep < depth)
        first, size, deep = first[open_], size[open_], deep[open_]
        if not len(first):
            break
        starts = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(first - starts, size)
        own = order[at]
        key = keys[own + np.repeat(deep, size)]
        a, b, c = key[starts], key[starts + size // 2], key[starts + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        side = (key > pivot).astype(np.int8) + (key >= pivot)
        moved = np.empty_like(own)
        to = _ternary(side, starts, size)
        moved[to] = own
        order[at] = moved
        counts = np.stack([np.add.reduceat(side == s, starts) for s in range(3)], axis=1)
        offsets = first[:, None] + np.cumsum(counts, axis=1) - counts
        some = counts > 0
        first, size = offsets[some], counts[some]
        deep = (deep[:, None] + np.array([0, WORD, 0]))[some]
        begins[first] = True
    return order, begins


def _common(keys: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, length: int) -> np.ndarray:
    """The bytes that windows a and b share, from depth (where they are known to) up to length."""
    out = np.full(len(a), length, np.int64)
    open_ = np.arange(len(a))
    d = depth
    while len(open_) and d < length:
        differ = keys[a[open_] + d] ^ keys[b[open_] + d]
        found = np.flatnonzero(differ)
        if len(found):
            own, x = open_[found], differ[found]
            lead = np.zeros(len(x), np.int64)  # equal bytes at the front of the word
            for j in range(1, WORD):
                lead += (x >> np.uint64(8 * (WORD - j))) == 0
            out[own] = np.minimum(d + lead, length)
            open_ = open_[differ == 0]
        d += WORD
    return out


def blind_tries(keys: np.ndarray, text: np.ndarray, order: np.ndarray, begins: np.ndarray, length: int, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """order with each group sorted by `length` bytes, and where groups of equal windows begin.

    A blind trie knows of its branches only their depth and the bytes that tell them apart. A group is put into one at a time along
    the path of one of its windows: each member is compared with that window alone, and branches off at the depth and byte where they
    differ. Members that branch off together are a smaller trie, for which the same is done.
    """
    order, begins = order.copy(), begins.copy()
    rng = np.random.default_rng(len(order))
    first = np.flatnonzero(begins)
    size = np.diff(np.r_[first, len(order)])
    while True:
        keep = size > 1
        first, size = first[keep], size[keep]
        if not len(first):
            return order, begins
        starts = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(first - starts, size)
        own, of = order[at], np.repeat(np.arange(len(first)), size)
        path = own[starts + rng.integers(0, size)][of]
        shared = _common(keys, own, path, depth, length)
        here = np.minimum(shared, length - 1)
        mine, other = text[own + here].astype(np.int64), text[path + here].astype(np.int64)
        # before the path: the shallow branches first; then what equals it; behind it the deep branches first
        rank = np.where(shared >= length, 0, np.where(mine < other, shared - length - 1, length + 1 - shared))
        by = np.lexsort((mine, rank, of))
        order[at] = own[by]
        of, rank, mine = of[by], rank[by], np.where(rank[by] == 0, 0, mine[by])
        new = np.r_[True, (of[1:] != of[:-1]) | (rank[1:] != rank[:-1]) | (mine[1:] != mine[:-1])]
        begins[at[new]] = True
        runs = np.flatnonzero(new)
        tied = rank[runs] != 0  # what equals the path is done
        first, size = at[runs][tied], np.diff(np.r_[runs, len(at)])[tied]


def equal_windows(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of the `length` bytes that begin there, all within text, and where groups of equal ones begin."""
    keys = words_at(text)
    order, begins = quicksort(keys, starts, min(SHALLOW, length // WORD * WORD))
    return blind_tries(keys, text, order, begins, length, min(SHALLOW, length // WORD * WORD))
