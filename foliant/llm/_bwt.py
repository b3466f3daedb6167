"""Burrows-Wheeler transforms of shards of strings, merged by iterative interleave refinement.

A shard is a list of byte strings, each ended by a symbol of its own that is
less than all bytes. Its transform is its last column: the symbol before every
suffix, in the order of the suffixes. Only the last column and the number of
strings go on; the suffixes' places are found from it when they are needed
(``places``), by walking all strings backwards at once.

``merge`` never sorts or compares suffixes. It begins with one shard after the
other, and refines this interleave: a pass deals the rows of a block by their
last symbol, which moves each row to the row before it (a counting pass), so
that rows in order by k - 1 symbols come to be in order by k. A pass need look
only at the blocks that the pass before has split, and at all but the largest
part of each. The pass in which two neighbours part gives their longest common prefix, one symbol less; blocks not
parted after ``depth`` passes are the intervals of suffixes that share depth
symbols at least, the repeated strings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HEAD = 7  # symbols of 9 bits in a sort key
DENSE = 7  # passes of a merge that deal all rows


@dataclass
class Transform:
    """last: the symbols before the suffixes in order, byte + 1, or 0 where a string begins; n: its strings."""

    last: np.ndarray
    n: int

    def packed(self) -> tuple[bytes, bytes]:
        """The last column in bytes, and the rows where strings begin."""
        begins = np.flatnonzero(self.last == 0).astype(np.uint32)
        return (np.maximum(self.last, 1) - 1).astype(np.uint8).tobytes(), begins.tobytes()

    @staticmethod
    def unpacked(last: bytes, begins: bytes) -> Transform:
        column, at = np.frombuffer(last, dtype=np.uint8).astype(np.uint16) + np.uint16(1), np.frombuffer(begins, dtype=np.uint32)
        column[at] = 0
        return Transform(column, len(at))


def transform(strings: list[bytes]) -> Transform:
    """The transform of one shard; equal suffixes are in the order of their strings."""
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1 if len(strings) else 0
    symbols = np.zeros(n, dtype=np.uint16)
    inside = np.ones(n, dtype=bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.uint16) + np.uint16(1)
    room = np.repeat(ends, sizes + 1) - np.arange(n)  # symbols before the string's end
    head = np.zeros(n + 1, dtype=np.uint64)
    wide = symbols.astype(np.uint64) << np.uint64(9 * (HEAD - 1))
    for _ in range(HEAD):  # nothing after a string's end
        head[:n] = np.where(inside, wide | head[1:] >> np.uint64(9), 0)
    head = head[:n]
    order = np.argsort(head)
    new = np.concatenate(([True], head[order][1:] != head[order][:-1])) if n else np.zeros(0, dtype=bool)
    # equal suffixes that end within the head are put in the order of their strings, each in a place of its own
    ended = np.flatnonzero(room[order] < HEAD)
    order[ended] = np.sort(np.cumsum(new)[ended] << 32 | order[ended]) & 0xFFFFFFFF
    new[ended] = True
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    shared = np.sort(order[~(new & np.concatenate((new[1:], [True])))]) if n else order
    step = HEAD
    while len(shared):  # these share step symbols and have more
        first, second = rank[shared], rank[shared + step]
        by = np.argsort(first << 32 | second, kind="stable")
        at, old, second = shared[by], first[by], second[by]
        new_old = np.concatenate(([True], old[1:] != old[:-1]))
        new = new_old | np.concatenate(([True], second[1:] != second[:-1]))
        index = np.arange(len(at))
        rank[at] = old + np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(new_old, index, 0))
        shared = np.sort(at[~(new & np.concatenate((new[1:], [True])))])
        step *= 2
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank] = np.arange(n)
    return Transform(symbols[suffixes - 1], len(strings))


def before(last: np.ndarray) -> np.ndarray:
    """The row of the suffix that is one symbol longer, of each row, by counting symbols; of rows that begin a string: none of use."""
    out = np.empty(len(last), dtype=np.uint32)
    out[np.argsort(last, kind="stable")] = np.arange(len(last), dtype=np.uint32)
    return out


def places(shard: Transform, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The string and the offset in it of each row. sizes: of the strings, in their order."""
    longer = before(shard.last)
    owner, offset = np.empty(len(shard.last), dtype=np.int64), np.empty(len(shard.last), dtype=np.int64)
    row, who, left = np.arange(shard.n), np.arange(shard.n), np.asarray(sizes, dtype=np.int64)
    while len(row):  # the ends of the strings are the first rows
        owner[row], offset[row] = who, left
        more = left > 0
        row, who, left = longer[row[more]].astype(np.int64), who[more], left[more] - 1
    return owner, offset


def _by_digits(key: np.ndarray, top: int) -> np.ndarray:
    """A stable counting order of keys from 0 to top, 16 bits at a time."""
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while top >> shift:
        order = order[np.argsort((key[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one after the other, and the range of each."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(len(which)) + (starts - (np.cumsum(sizes) - sizes))[which], which


def merge(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of all rows (numbered shard after shard), and the common prefix of each with the one before, depth at most.

    A block's rows lie together, in any order. When a block of suffixes w...
    has been split into children, each block cw... is split likewise by
    the rows whose last symbol is c. The largest child need not be looked at:
    the rows of cw... that come from no other child stay in the middle, the
    others move before or behind them. So a row moves about log(n) times.
    """
    if not shards:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = np.cumsum([0, *(len(s.last) for s in shards)])[:-1]
    last = np.concatenate([s.last for s in shards])
    longer = np.concatenate([before(s.last).astype(np.int32) + np.int32(a) for s, a in zip(shards, starts, strict=True)])
    n = len(last)
    first = np.concatenate([np.sort(s.last, kind="stable") for s in shards])  # a sorted last column is the first one
    order = np.argsort(first, kind="stable").astype(np.int32)
    common = np.full(n, depth, dtype=np.int16 if depth < 2**15 else np.int64)
    symbol = first[order]
    parted = np.concatenate(([True], symbol[1:] != symbol[:-1])) if n else np.zeros(0, dtype=bool)
    common[parted] = 0
    # the first passes split nearly all blocks: they deal all rows
    ends = int(np.searchsorted(symbol, 1))  # the strings' ends are the first block and stay there
    done = 1
    while done < min(DENSE, depth):
        label = np.cumsum(parted, dtype=np.int32)
        c = last[order]
        some = np.flatnonzero(c)
        some = some[np.argsort(c[some], kind="stable")]
        c, label = c[some], label[some]
        order[ends:] = longer[order[some]]
        parted[ends + 1 :] = (c[1:] != c[:-1]) | (label[1:] != label[:-1])
        common[parted & (common == depth)] = done
        done += 1
    place = np.empty(n, dtype=np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    # the block of each row, where blocks begin and end; the children of split blocks in order, and the block each is of
    cut = np.flatnonzero(parted)
    begin, end = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    blocks = len(cut)
    begin[:blocks], end[:blocks] = cut, np.append(cut[1:], n)
    block = np.empty(n, dtype=np.int32)
    block[order] = np.repeat(np.arange(blocks, dtype=np.int32), end[:blocks] - begin[:blocks])
    parent = np.cumsum(common[cut] < done - 1) if done > 1 else np.zeros(blocks, dtype=np.int64)
    several = np.bincount(parent, minlength=1)[parent] > 1
    low, high, parent = cut[several], np.append(cut[1:], n)[several], parent[several]
    moved, taken = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    for k in range(done + 1, depth + 1):
        if not len(low):
            break
        # the largest child of each split block is left out
        new = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        number = np.cumsum(np.concatenate(([False], parent[1:] != parent[:-1])))
        largest = np.maximum.reduceat((high - low) << 32 | np.arange(len(low)), new) & 0xFFFFFFFF
        chosen = np.ones(len(low), dtype=bool)
        chosen[largest] = False
        child = np.flatnonzero(chosen)
        at, which = _spread(low[child], high[child])
        child = child[which]
        row = order[at]
        c = last[row].astype(np.int64)
        some = c > 0
        row, child, c = longer[row[some]], child[some], c[some]
        if not len(row):
            break
        key = number[child] * 257 + c
        by = _by_digits(key, (int(number[-1]) + 1) * 257)
        row, child, key = row[by], child[by], key[by]
        group_new = np.concatenate(([True], key[1:] != key[:-1]))
        cut = np.flatnonzero(group_new)
        group = np.cumsum(group_new) - 1
        own = block[row[cut]]
        start, stop = begin[own], end[own]
        size = np.diff(np.append(cut, len(row)))
        behind = child > largest[number[child]]  # after what stays
        n_behind = np.add.reduceat(behind, cut, dtype=np.int64)
        n_ahead = size - n_behind
        index = np.arange(len(row)) - cut[group]
        to = np.where(behind, (stop - size)[group], start[group]) + index
        # the rows in their way take the places that they leave
        was = place[row]
        moved[row], taken[to] = True, True
        there = order[to]
        displaced, freed = there[~moved[there]], was[~taken[was]]
        moved[row], taken[to] = False, False
        order[to], place[row] = row, to
        order[freed], place[displaced] = displaced, freed
        # the children of the blocks now: runs of one child, and the middle
        run = np.flatnonzero(group_new | np.concatenate(([True], child[1:] != child[:-1])))
        run_end = np.append(run[1:], len(row)) - 1
        middle = np.flatnonzero(size < stop - start)
        several = np.bincount(group[run], minlength=len(cut)) + (size < stop - start) > 1
        lows = np.concatenate((to[run], (start + n_ahead)[middle]))
        highs = np.concatenate((to[run_end] + 1, (stop - n_behind)[middle]))
        groups = np.concatenate((group[run], middle))
        first_row = np.concatenate((run, np.full(len(middle), -1)))
        keep = several[groups]
        lows, highs, groups, first_row = lows[keep], highs[keep], groups[keep], first_row[keep]
        by = np.argsort(groups.astype(np.int64) << 32 | lows, kind="stable")
        low, high, parent, first_row = lows[by], highs[by], groups[by], first_row[by]
        common[low[low != start[parent]]] = k - 1
        # what stays keeps the block's number (the first run if all has moved); the other runs get new ones
        named = first_row >= 0
        whole = size == stop - start
        named[named] = ~(whole[parent[named]] & (low[named] == start[parent[named]]))
        fresh = np.arange(blocks, blocks + int(named.sum()))
        blocks += len(fresh)
        kept = ~named
        begin[own[parent[kept]]], end[own[parent[kept]]] = low[kept], high[kept]
        begin[fresh], end[fresh] = low[named], high[named]
        spots, which = _spread(low[named], high[named])
        block[order[spots]] = fresh[which]
    return order.astype(np.int64), common


def repeated(order: np.ndarray, common: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Whether each row's first depth symbols have a weight of more than one in all."""
    out = np.zeros(len(order), dtype=bool)
    if len(order):
        cut = np.flatnonzero(common < depth)
        total = np.add.reduceat(weight[order], cut)
        out[order] = np.repeat(total > 1, np.diff(np.append(cut, len(order))))
    return out
