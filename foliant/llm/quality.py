"""Rule-based text quality, with repetition measured by a suffix array.

All texts of a batch share one word-level suffix array (suffixes of one text
only compare with each other), refined by doubling. Ranks of every level give
the longest common prefixes of neighbours; the spans [position, position +
prefix) of at least ``window`` words are the occurrences of the maximal
repeated substrings, and their union is the covered fraction.

A text is kept if it passes the base rules (``min_words``, at most
``max_repeat_percent`` percent of its words in repeated windows) and the
longest repeat has at most ``max_longest`` words. Words are told apart by
their bytes. Common prefixes are followed as far as the rules ask, so memory is
a rank a word for each of about log2(max_longest) levels, however long and
repetitive a text is; ``longest_repeat`` is at most max_longest + 1.

Defined results: null and blank texts have no words and fail; any length of
text is judged whole; repeated rows are judged alike; an empty table gives an
empty table; no result depends on an order, so there are no ties; extra columns
are ignored unless named in ``keep`` (``carried`` names those that clash).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._common import carried, slices, string_buffer, word_names

PIECE_BYTES = 1 << 20
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def repeat_lengths(symbols: np.ndarray, before: np.ndarray, most: int) -> np.ndarray:
    """For each position, the longest prefix (most at most) of its suffix that another suffix of the same text starts with.

    symbols: numbers from 0 up; before: offsets of texts (n + 1). Prefix
    doubling keeps, for each level k, a rank of the prefixes of 2 ** k
    symbols, until these are longer than most; only positions whose rank is
    still shared are sorted again.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    small = np.int32 if n < 2**31 else np.int64
    owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
    end = before[1:][owner].astype(small)
    key = owner * (int(symbols.max()) + 1) + symbols
    index = np.arange(n)
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank = np.empty(n, dtype=small)
    rank[order] = np.maximum.accumulate(np.where(new, index, 0))
    levels, shared = [rank], np.sort(order[~(new & np.concatenate((new[1:], [True])))])
    step = 1
    while len(shared) and step <= most:
        to = shared + step
        second = np.zeros(len(shared), dtype=np.int64)
        inside = to < end[shared]
        second[inside] = rank[to[inside]].astype(np.int64) + 1
        first = rank[shared].astype(np.int64)
        by = np.argsort(first << 32 | second, kind="stable") if n < 2**31 else np.lexsort((second, first))
        at, old, second = shared[by], first[by], second[by]
        new_old = np.concatenate(([True], old[1:] != old[:-1]))
        new_key = new_old | np.concatenate(([True], second[1:] != second[:-1]))
        index = np.arange(len(at))
        base = np.maximum.accumulate(np.where(new_old, index, 0))
        group = np.maximum.accumulate(np.where(new_key, index, 0))
        rank = rank.copy()
        rank[at] = old + group - base
        levels.append(rank)
        shared = np.sort(at[~(new_key & np.concatenate((new_key[1:], [True])))])
        step *= 2
    # neighbours in the order by the last ranks, suffixes equal so far in any order
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1], order[1:]
    length = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        inside = np.flatnonzero((x < end[a]) & (y < end[b]))
        level = levels.pop()
        length[inside[level[x[inside]] == level[y[inside]]]] += 1 << k
    longest = np.zeros(n + 1, dtype=np.int64)
    longest[1:n] = np.minimum(length, most)
    out = np.empty(n, dtype=np.int64)
    out[order] = np.maximum(longest[:-1], longest[1:])
    return out


def covered_words(lengths: np.ndarray, window: int) -> np.ndarray:
    """Whether each position is inside a repeat of at least window words."""
    n = len(lengths)
    at = np.flatnonzero(lengths >= window)
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + lengths[at], -1)
    return np.cumsum(change)[:n] > 0


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def measures(column: pa.Array, window: int, most: int) -> dict[str, np.ndarray]:
    """The figures of each text of an Arrow string column; repeats are followed up to most words."""
    data, offsets = string_buffer(column)
    names, _, before = word_names(data, offsets, fold=False)
    blank = np.zeros(256, dtype=bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    points = ((data & 0xC0) != 0x80) & ~blank[data]
    lengths = repeat_lengths(names, before, most)
    longest = np.zeros(len(before) - 1, dtype=np.int64)
    some = np.diff(before) > 0
    if some.any():
        longest[some] = np.maximum.reduceat(lengths, before[:-1][some])
    dup_lines, raw = np.zeros(len(before) - 1, dtype=np.int64), data.tobytes()
    for i, (at, to) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        lines = [x for x in raw[at:to].split(b"\n") if x and not x.isspace()]
        dup_lines[i] = len(lines) - len(set(lines))
    return {
        "n_words": np.diff(before),
        "word_chars": _sums(points, offsets),
        "n_symbols": _sums(_SYMBOLS[data], offsets),
        "n_dup_lines": dup_lines,
        "n_repeat_words": _sums(covered_words(lengths, window), before),
        "longest_repeat": longest,
    }


def quality_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), min_words: int = 10, window: int = 5, max_repeat_percent: int = 20, max_longest: int = 400) -> DataFrame:
    """keep columns with the measures, base_failed and kept; one row for each row of docs."""
    kept = docs.select(*[docs[c].alias(f"k_{i}") for i, c in enumerate(keep)], docs[text].alias("_text"))
    n = len(keep)
    carry = [f"k_{i}" for i in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_text", PIECE_BYTES):
                m = measures(piece.column(n), window, max(window, max_longest + 1))
                failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])
                good = ~failed & (m["longest_repeat"] <= max_longest)
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(n)), *map(pa.array, m.values()), pa.array(failed), pa.array(good)], [*carry, *m, "base_failed", "kept"])

    schema = "".join(f"k_{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "base_failed", "kept"]
    out = kept.mapInArrow(run, f"{schema}n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, base_failed boolean, kept boolean")
    return out.select(*[F.col(f"k_{i}").alias(name) for i, (_, name) in enumerate(carried(keep, results))], *results)
