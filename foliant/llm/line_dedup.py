"""Fuzzy line deduplication: one line stays of each group of similar lines.

A line is a ``\\n``-separated piece of a text; lines without a word always
stay. Its set is its distinct shingles of ``width`` characters (code points;
a shorter line is one shingle). One-permutation MinHash with universal
densification gives 80 minima in 20 bands of 4 (a pair at similarity 0.8 is
missed with probability 2.6e-5, at 0.85 with 4e-7); candidates are verified by
exact Jaccard similarity, shingles compared by their characters, and joined by
distributed union-find. Equal lines are one node, known by 128 bits of hashes.
Of each component the line first in (document id, text hash, line number)
stays.

Defined results: null texts stay null; a text whose lines all stay is not
changed; an empty text is one line; nulls order first among ids; rows equal in
id and text are one document, and each of them keeps that document's lines;
very long texts are read whole; an empty table gives an empty table. Extra
columns named in ``keep`` are carried (``carried`` names those that clash).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm._common import _SPACE_TABLE, MULTIPLIERS, Stage, carried, mix, signed, slices, string_buffer
from foliant.llm._lsh import Sets, band_keys, binned_minima, similar_components

PIECE_BYTES = 1 << 20
BANDS, ROWS = 20, 4
LEAST_SHARE = 0.55  # of equal minima; at similarity 0.8 more than five standard deviations below
SEEN = 200_000  # line hashes that a worker remembers, so as not to sign equal lines again
_U = np.uint64
NARROW = 8  # code points below 256 that a 64-bit number holds


def _packed(points: np.ndarray, width: int) -> np.ndarray:
    """The number of width bytes from each position on."""
    out, have = points.astype(_U), 1
    while have < width:
        step = min(have, width - have)
        out = out[: len(out) - step] | (out[step:] >> _U(8 * (have - step)) << _U(8 * have))
        have += step
    return out


def unhashed(column: pa.Array, width: int) -> np.ndarray:
    """Whether the values of a line's shingles are no hashes: all code points below 256, width of them at least, 8 at most in a shingle."""
    data, offsets = string_buffer(column)
    if width > NARROW or not len(data):
        return np.zeros(len(column), dtype=bool)
    wide, points = np.zeros(len(data) + 1, dtype=np.int32), np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(data >= 0xC4, out=wide[1:], dtype=np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:], dtype=np.int32)
    return (wide[offsets[1:]] == wide[offsets[:-1]]) & (points[offsets[1:]] - points[offsets[:-1]] >= width)


def line_shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit values of all character shingles, repeats included, and the line of each.

    A shingle of 8 code points below 256 at most is its own value (mixed one
    to one); others are hashed. Every non-empty line has a shingle at least.
    """
    data, offsets = string_buffer(column)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    if len(points) < len(data):
        upto = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=upto[1:])
        offsets = upto[offsets]
    sizes = np.diff(offsets)
    n = max(len(points) - width + 1, 0)
    wide = points > 0xFF if width <= NARROW else np.ones(len(points), dtype=bool)
    value = _packed(points & 0xFF, width) if n and width <= NARROW else np.zeros(n, dtype=_U)
    if wide.any():
        bad = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(wide, out=bad[1:])
        at = np.flatnonzero(bad[width:] > bad[:n])
        hashed = np.zeros(len(at), dtype=_U)
        for k in range(width):
            hashed = mix(hashed * MULTIPLIERS[8] + points[at + k])
        value[at] = hashed
    counts = np.where(sizes >= width, sizes - width + 1, 0)
    inside = np.ones(n, dtype=bool)  # shingles of one line
    for k in range(1, width):
        cross = offsets[1:-1] - k
        inside[cross[(cross >= 0) & (cross < n)]] = False
    value, owner = mix(value[inside]), np.repeat(np.arange(len(sizes)), counts)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):  # the whole line and its length
        own = np.array([hash_points(points[offsets[i] : offsets[i + 1]]) for i in short.tolist()], dtype=_U)
        owner, value = np.concatenate((owner, short)), np.concatenate((value, own))
        order = np.argsort(owner, kind="stable")
        owner, value = owner[order], value[order]
    return value, owner


def hash_points(points: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(points.tobytes(), len(points))


def sets_of(column: pa.Array, width: int) -> list[np.ndarray]:
    hashes, owner = line_shingles(column, width)
    cut = np.searchsorted(owner, np.arange(len(column) + 1))
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        own = np.sort(hashes[a:b])
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own)
    return out


def exact_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct shingles of each line as numbers, equal for equal strings within this column."""
    names: dict[str, int] = {}
    out = []
    for line in column.to_pylist():
        line = line or ""
        own = {line[i : i + width] for i in range(max(1, len(line) - width + 1))} if line else set()
        out.append(np.array(sorted(names.setdefault(x, len(names)) for x in own), dtype=np.int64))
    return out


#: Seeds of XXH64 that make a line's id and its check, the same here as in Spark's xxhash64(line) and xxhash64(1, line).
ID_SEED, CHECK_SEED = 42, xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """line, id of all lines, also those without a word."""
    # split first: beside the generator it would be done for every line
    whole = docs.select(F.split(docs[text], "\n", -1).alias("lines"))
    return whole.select(F.explode("lines").alias("line")).withColumn("id", F.xxhash64("line"))


def line_check(line: str) -> Column:
    """The check of a line in column line, as the workers make it with CHECK_SEED."""
    return F.xxhash64(F.lit(1), line)


def split_lines(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All lines with a word of a column of texts, their row and their number in the text."""
    data, offsets = string_buffer(column)
    some = offsets[1:] > offsets[:-1]
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1][some], breaks + 1)), kind="stable")
    ends = np.sort(np.concatenate((breaks, offsets[1:][some])), kind="stable")
    # a text that ends in a line feed has an empty last line; starts and ends still pair up, text by text
    row = np.repeat(np.flatnonzero(some), np.diff(np.searchsorted(breaks, offsets))[some] + 1)
    number = np.arange(len(row)) - np.searchsorted(row, row)
    words = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(~_SPACE_TABLE[data], out=words[1:], dtype=np.int32)
    keep = words[ends] > words[starts]
    starts, ends, row, number = starts[keep], ends[keep], row[keep], number[keep]
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    kept = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    lines = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes()))
    return lines, row, number


def _signed_lines(docs: DataFrame, doc_id: str, text: str, width: int, id_type: str) -> DataFrame:
    """doc_id, text_hash, line_no, id, check, bands, signature of all lines with a word; the last two null where this worker has signed an equal line before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece in slices(batch, "_text", PIECE_BYTES):
                lines, row, number = split_lines(piece.column(2))
                data, offsets = string_buffer(lines)
                raw, bounds, n = data.tobytes(), offsets.tolist(), len(lines)
                pieces = [raw[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
                ids, checks = (np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in pieces), dtype=_U, count=n).view(np.int64) for seed in (ID_SEED, CHECK_SEED))
                _, first = np.unique(ids, return_index=True)
                new = np.sort(np.array([i for i in first.tolist() if int(ids[i]) not in seen], dtype=np.int64))
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(ids[new].tolist())
                fresh = np.zeros(n, dtype=bool)
                fresh[new] = True
                parts, owners, at = [], [], 0
                for sub in slices(pa.RecordBatch.from_arrays([lines.take(pa.array(new))], ["line"]), "line", PIECE_BYTES // 4):
                    hashes, owner = line_shingles(sub.column(0), width)
                    parts.append(hashes)
                    owners.append(owner + at)
                    at += sub.num_rows
                empty = [np.zeros(0, dtype=_U)], [np.zeros(0, dtype=np.int64)]
                minimal = binned_minima(np.concatenate(parts or empty[0]), np.concatenate(owners or empty[1]), len(new), BANDS * ROWS)
                keys, low = band_keys(minimal, BANDS, ROWS), (minimal & 0xFF).astype(np.uint8)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(fresh) * BANDS)).astype(np.int32)), signed(keys.ravel()))
                marks = np.full(n, None, dtype=object)
                marks[new] = [x.tobytes() for x in low]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(take), piece.column(1).take(take), pa.array(number.astype(np.int32)), pa.array(ids), pa.array(checks), lists, pa.array(marks, type=pa.binary())], ["doc_id", "text_hash", "line_no", "id", "check", "bands", "signature"])

    whole = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("text_hash"), docs[text].alias("_text"))
    return whole.mapInArrow(run, f"doc_id {id_type}, text_hash long, line_no int, id long, check long, bands array<long>, signature binary")


def without_lines(df: DataFrame) -> DataFrame:
    """df (text, gone: numbers of lines or null, and others) with text without those lines, n_lines and n_removed."""
    # the lines come out of a generator, so that they are not split anew for each one kept
    parted = df.withColumn("_lines", F.explode(F.array(F.when(F.col("gone").isNotNull(), F.split("text", "\n", -1)))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "gone")
    text = F.when(F.col("_lines").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    counts = {"n_lines": F.coalesce(breaks + 1, F.lit(0)).cast("long"), "n_removed": F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long")}
    return parted.withColumns({**counts, "text": text}).drop("_lines", "gone")


def fuzzy_line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), width: int = 8, percent: int = 80) -> DataFrame:
    """doc_id, text (only its kept lines), n_lines, n_removed and the keep columns: one row for each row of docs."""
    stage = Stage(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = stage.put(_signed_lines(docs, doc_id, text, width, id_type), random=True)
    checked: list[DataFrame] = []

    def texts(ids: DataFrame) -> DataFrame:
        own = _lines(docs, text).join(stage.small(ids), "id", "left_semi").select("id", line_check("line").alias("check"), F.col("line").alias("text"))
        checked.append(stage.put(own.dropDuplicates(["id"])))
        return checked[0]

    items = rows.where(F.size("bands") > 0).select("id", "bands", "signature")
    sets = Sets(lambda column: sets_of(column, width), lambda column: exact_sets(column, width), lambda column: unhashed(column, width))
    found = similar_components(stage, items, texts, sets, percent, LEAST_SHARE, stage.rows(rows) * BANDS)
    # links hold for the line that was compared; one of the same id but another check is only like itself
    found = stage.put(found.withColumnRenamed("node", "id").join(checked[0].select("id", F.col("check").alias("of")), "id"))
    placed = rows.select("doc_id", "text_hash", "line_no", "id", "check").join(stage.small(found), "id", "left")
    linked = F.col("check") == F.col("of")
    placed = placed.select("doc_id", "text_hash", "line_no", F.when(linked, F.col("component")).otherwise(F.col("id")).alias("c"), F.when(linked, F.lit(0)).otherwise(F.col("check")).alias("c2"))
    often = stage.put(placed.groupBy("c", "c2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c", "c2"))
    again = stage.put(placed.join(stage.small(often), ["c", "c2"]))
    stage.drop(rows)
    place = F.struct("doc_id", "text_hash", "line_no")
    firsts = stage.put(again.groupBy("c", "c2").agg(F.min(place).alias("first")))
    later = again.join(stage.small(firsts), ["c", "c2"]).where(~place.eqNullSafe(F.col("first")))
    gone = later.groupBy(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash")).agg(F.collect_set("line_no").alias("gone"))
    own = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("h"), *[docs[c].alias(f"k_{i}") for i, c in enumerate(keep)])
    joined = own.join(gone, own["doc_id"].eqNullSafe(gone["s_id"]) & (own["h"] == gone["s_hash"]), "left").select("doc_id", "text", "gone", *[f"k_{i}" for i in range(len(keep))])

    results = ["doc_id", "text", "n_lines", "n_removed"]
    return without_lines(joined).select(*results, *[F.col(f"k_{i}").alias(name) for i, (_, name) in enumerate(carried(keep, results))])
