"""Removal of every byte covered by a string of ``least`` bytes that occurs elsewhere too.

1. Anchors. Of the 32-byte grams of each window of ``least`` bytes the one of
   least hash is an anchor (the last of equals). Equal windows have equal
   anchors at equal offsets, so both ends of a repeat share an anchor's gram.
   Grams seen once drop out.
2. Contexts. The windows that have an anchor lie in the bytes around it. Anchors of
   equal gram and equal context (128 bits of hashes) repeat whole: done. Of
   the grams with several contexts, each distinct context goes on once, with
   its number of occurrences.
3. Transforms. Grams are dealt into groups of about ``GROUP_BYTES``, and the
   contexts of a group into ``SHARDS`` shards. A task makes the Burrows-Wheeler
   transform of each shard (``_bwt``); only transforms go on. Another task
   merges those of a group by iterative interleave refinement, which gives the
   common prefixes; a window is repeated if its interval of suffixes with
   ``least`` bytes in common holds another occurrence. No suffix is sorted
   again after its shard.
4. A gram with more than ``MOST`` contexts is first split: the windows'
   offsets are cut into four ranges, each of which has a core that all its
   windows contain; contexts go on by the core's hash. After four splits a
   range is one window, whose equal contexts are counted. So no group is
   collected that grows with the data, and none is sampled or cut short.
5. Spans are joined per document and the bytes removed from the whole text.

Documents are told apart by id and text hash; equal rows are occurrences of
each other. Defined results: null and empty texts have no bytes; texts
shorter than ``least`` bytes are kept whole; very long texts are read whole; a
null id is an id; all copies of a string go, so there are no ties; an empty
table gives an empty table; extra columns named in ``keep`` are carried
(``carried`` names those that clash).
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import _bwt
from foliant.llm._common import Stage, carried, mix, powers, prefix_sums, signed, slices, string_buffer

GRAM = 32
PIECE_BYTES = 1 << 20
SEGMENT = 1 << 23
GROUP_BYTES, SHARDS, MOST = 1 << 19, 4, 2048
_U = np.uint64
_LOW = (1 << 24) - 1  # of a position within a segment


def anchors(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted positions of all anchors of texts, their gram hashes, and the first and last start of the windows that have it as anchor."""
    found: list[tuple[np.ndarray, ...]] = []
    n = len(data)
    for at in range(0, n, SEGMENT):
        part = data[at : at + SEGMENT + least - 1]
        if len(part) < least:
            break
        m = len(part) - GRAM + 1
        prefix = prefix_sums(part)
        gram = mix((prefix[GRAM:] - prefix[:m]) * powers(len(part), True)[:m])
        best = gram & ~_U(_LOW) | (_U(_LOW) - np.arange(m, dtype=_U))
        width, span = 1, least - GRAM + 1
        while width * 2 <= span:
            best = np.minimum(best[: len(best) - width], best[width:])
            width *= 2
        windows = len(part) - least + 1
        best = np.minimum(best[:windows], best[span - width : span - width + windows])
        inside = np.zeros(windows, dtype=np.int32)  # windows within one text
        starts, ends = offsets[:-1] - at, offsets[1:] - at - least + 1
        good = (ends > starts) & (ends > 0) & (starts < windows)
        np.add.at(inside, np.maximum(starts[good], 0), 1)
        stop = ends[good]
        np.add.at(inside, stop[stop < windows], -1)
        start = np.flatnonzero(np.cumsum(inside) > 0)
        if not len(start):
            continue
        anchor = (_U(_LOW) - (best[start] & _U(_LOW))).astype(np.int64)  # rises with the windows
        new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.append(new[1:], len(anchor)) - 1
        found.append((anchor[new] + at, gram[anchor[new]], start[new] + at, start[last] + at))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, np.zeros(0, dtype=_U), none, none
    position, gram, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.flatnonzero(np.concatenate(([True], position[1:] != position[:-1])))  # one may have windows in two segments
    return position[new], gram[new], np.minimum.reduceat(first, new), np.maximum.reduceat(last, new)


def _anchor_rows(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """doc_id, h, key (gram), c (context), at, l, r: bytes at - l .. at + r are the context."""
    rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("h"), docs[text].alias("_text"))
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_text", PIECE_BYTES):
                data, offsets = string_buffer(piece.column(2))
                at, gram, first, last = anchors(data, offsets, least)
                row = np.searchsorted(offsets, at, side="right") - 1
                left, right = at - first, last + least - at
                raw = data.tobytes()
                c = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:z], k) for a, z, k in zip((at - left).tolist(), (at + right).tolist(), left.tolist(), strict=True)), dtype=_U, count=len(at))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(take), piece.column(1).take(take), signed(gram), signed(c), pa.array(at - offsets[row]), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))], ["doc_id", "h", "key", "c", "at", "l", "r"])

    return rows.mapInArrow(run, f"doc_id {id_type}, h long, key long, c long, at long, l int, r int")


def _cut_contexts(joined: DataFrame, id_type: str) -> DataFrame:
    """doc_id, h, key, n, m, at (of the anchor), low, high (offsets of the windows' starts to it), start (of body), body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_text", PIECE_BYTES):
                data, offsets = string_buffer(piece.column(2))
                lists = piece.column(3)
                sizes = np.asarray(lists.value_lengths())
                row = np.repeat(np.arange(piece.num_rows), sizes)
                flat = lists.flatten()
                f = {flat.type.field(i).name: np.asarray(flat.field(i)) for i in range(flat.type.num_fields)}
                start = f["at"] - f["l"]
                base = offsets[row]
                raw = data.tobytes()
                body = [raw[a:b] for a, b in zip((base + start).tolist(), (base + f["at"] + f["r"]).tolist(), strict=True)]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(take), piece.column(1).take(take), *(pa.array(f[k]) for k in ("key", "n", "m", "at")), pa.array(-f["l"]), pa.array(start), pa.array(body, type=pa.binary())], ["doc_id", "h", "key", "n", "m", "at", "low", "start", "body"])

    return joined.mapInArrow(run, f"doc_id {id_type}, h long, key long, n long, m long, at long, low int, start long, body binary")


def _split(rows: DataFrame, least: int, wide: int, id_type: str) -> DataFrame:
    """Each context as four rows of a quarter of its window offsets: key (of the core), c, n, ... wide: offsets that a row covers.

    The range of a row starts at offset ``low`` on a grid that depends on the
    anchor only, so equal windows fall in equal ranges.
    """
    part = -(-wide // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                get = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
                body = get["body"].to_pylist()
                size = np.array([len(x) for x in body], dtype=np.int64)
                grid, at, start = (np.asarray(get[k]).astype(np.int64) for k in ("grid", "at", "start"))
                i, q = (x.ravel() for x in np.meshgrid(np.arange(batch.num_rows), np.arange(4), indexing="ij"))
                first, end = grid[i] + q * part, np.minimum(grid[i] + (q + 1) * part, grid[i] + wide)  # offsets first .. end - 1
                base = (start - at)[i]  # offset of the body's first byte
                a, z = np.maximum(first, base), np.minimum(end - 1, base + size[i] - least)
                some = np.flatnonzero(a <= z)
                i, q, first, end, base, a, z = (x[some] for x in (i, q, first, end, base, a, z))
                cores = [body[k][x:y] for k, x, y in zip(i.tolist(), (end - 1 - base).tolist(), (first - base + least).tolist(), strict=True)]
                own = [body[k][x:y] for k, x, y in zip(i.tolist(), (a - base).tolist(), (z - base + least).tolist(), strict=True)]
                seeds = mix(np.asarray(get["key"]).view(_U)[i] + q.astype(_U)).tolist()
                mark = np.fromiter((xxhash.xxh3_64_intdigest(x, k) for x, k in zip(cores, seeds, strict=True)), dtype=_U, count=len(cores))
                c = np.fromiter((xxhash.xxh3_64_intdigest(x, k) for x, k in zip(own, (a - first).tolist(), strict=True)), dtype=_U, count=len(own))
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([get["doc_id"].take(take), get["h"].take(take), signed(mark), signed(c), get["n"].take(take), get["at"].take(take), pa.array(a.astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(at[i] + a), pa.array(own, type=pa.binary())], ["doc_id", "h", "key", "c", "n", "at", "low", "grid", "start", "body"])

    chosen = rows.select("doc_id", "h", "key", "n", "at", "low", "grid", "start", "body")
    return chosen.mapInArrow(run, f"doc_id {id_type}, h long, key long, c long, n long, at long, low int, grid int, start long, body binary")


def repeated_windows(shards: list[_bwt.Transform], sizes: list[np.ndarray], counts: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, first and last start of the runs of windows that occur again, of strings that count once.

    sizes, counts: of each shard's strings; strings are numbered shard after shard.
    """
    order, common = _bwt.merge(shards, least)
    found = [_bwt.places(s, n) for s, n in zip(shards, sizes, strict=True)]
    first = np.cumsum([0, *(len(n) for n in sizes)])[:-1]
    owner, offset = np.concatenate([o + a for (o, _), a in zip(found, first, strict=True)]), np.concatenate([x for _, x in found])
    size, count = np.concatenate(sizes), np.concatenate(counts)
    whole = size[owner] - offset >= least
    again = _bwt.repeated(order, common, np.where(whole, count[owner], 0), least) & whole & (count[owner] == 1)
    place = np.sort(owner[again] << 32 | offset[again])
    new = np.concatenate(([True], place[1:] != place[:-1] + 1)) if len(place) else np.zeros(0, dtype=bool)
    begin, end = place[new], place[np.concatenate((new[1:], [True]))] if len(place) else place
    return begin >> 32, begin & (2**32 - 1), end & (2**32 - 1)


def _held(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(batch.column(k)) for k in range(keys)])
        cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, z in itertools.pairwise(cut):
            if held and tuple(key[:, a]) != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, z - a))
            last = tuple(key[:, a])
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _merged_spans(rows: DataFrame, least: int, id_type: str) -> DataFrame:
    """doc_id, h, start, end: the bytes of contexts seen once that windows of other contexts cover. rows: key, n, start, body, doc_id, h."""
    total = rows.agg(F.sum(F.length("body"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    dealt = rows.select(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("g"), F.pmod(F.xxhash64("doc_id", "h", "start"), F.lit(SHARDS)).alias("shard"), "doc_id", "h", "n", "start", "body")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _held(batches, 2):
            bodies = t.column("body").to_pylist()
            last, begins = _bwt.transform(bodies).packed()
            lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], type=pa.int32()), pa.concat_arrays(t.column(c).chunks)) for c in ("doc_id", "h", "n", "start")]
            sizes = pa.array([[len(x) for x in bodies]], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([t.column("g").chunk(0)[:1], pa.array([last], type=pa.binary()), pa.array([begins], type=pa.binary()), *lists, sizes], ["g", "last", "begins", "doc_id", "h", "n", "start", "sizes"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _held(batches, 1):
            every = {c: pa.concat_arrays(t.column(c).chunks) for c in ("doc_id", "h", "n", "start", "sizes")}
            each = lambda c: [np.asarray(every[c].slice(i, 1).flatten()) for i in range(t.num_rows)]
            transforms = [_bwt.Transform.unpacked(a, b) for a, b in zip(t.column("last").to_pylist(), t.column("begins").to_pylist(), strict=True)]
            string, first, last = repeated_windows(transforms, each("sizes"), each("n"), least)
            take, start = pa.array(string), np.asarray(every["start"].flatten())[string]
            yield pa.RecordBatch.from_arrays([every["doc_id"].flatten().take(take), every["h"].flatten().take(take), pa.array(start + first), pa.array(start + last + least)], ["doc_id", "h", "start", "end"])

    made = dealt.repartition("g", "shard").sortWithinPartitions("g", "shard").mapInArrow(shards, f"g long, last binary, begins binary, doc_id array<{id_type}>, h array<long>, n array<long>, start array<long>, sizes array<long>")
    return made.repartition("g").sortWithinPartitions("g").mapInArrow(merged, f"doc_id {id_type}, h long, start long, end long")


def repeated_spans(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """doc_id, h, start, end: byte spans, overlapping, whose union are the bytes to remove."""
    outer, stage = Stage(docs.sparkSession), Stage(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()
    found = stage.put(_anchor_rows(docs, doc_id, text, least))
    grams = found.groupBy("key").agg(F.count(F.lit(1)).alias("total"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("total > 1")
    # written first: a join with the aggregate itself would keep its partitioning, and a frequent gram in one task
    grams = stage.put(grams.select("key", (F.col("lo") != F.col("hi")).alias("several")))
    again = stage.put(found.join(stage.small(grams), "key"))
    stage.drop(found, grams)
    whole = again.where("not several")
    several = again.where("several").drop("several")
    contexts = stage.put(several.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "h", "at", "l", "r")).alias("one")))
    often = stage.put(contexts.where("n > 1").select("key", "c"))
    whole = whole.drop("several").unionByName(several.join(stage.small(often), ["key", "c"]))
    spans = whole.where(F.col("l") + F.col("r") >= least).select("doc_id", "h", (F.col("at") - F.col("l")).alias("start"), (F.col("at") + F.col("r")).alias("end"))
    # distinct contexts of grams that have one seen once
    needed = contexts.groupBy("key").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("m")).where("least = 1").select("key", "m")
    once = contexts.join(needed, "key").select("key", "n", "m", "one.*")
    per_doc = once.groupBy("doc_id", "h").agg(F.collect_list(F.struct("key", "n", "m", "at", "l", "r")).alias("list"))
    own = docs.select(docs[doc_id].alias("d_id"), F.xxhash64(docs[text]).alias("d_h"), docs[text].alias("_text"))
    joined = own.join(per_doc, own["d_id"].eqNullSafe(per_doc["doc_id"]) & (own["d_h"] == per_doc["h"])).select("d_id", "d_h", "_text", "list")
    bodies = stage.put(_cut_contexts(joined, id_type))
    parts = [spans, _merged_spans(bodies.where(F.col("m") <= MOST), least, id_type)]
    wide = least - GRAM + 1
    hot = bodies.where(F.col("m") > MOST).withColumn("grid", F.lit(-(least - GRAM)))
    while hot.limit(1).count():  # four times at most: then a range is one window, and its contexts are equal
        pieces = stage.put(_split(hot, least, wide, id_type))
        wide = -(-wide // 4)
        cores = pieces.groupBy("key").agg(F.sum("n").alias("total"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m")).where("total > 1")
        joined = stage.put(pieces.drop("m").join(cores.select("key", "lo", "hi", "m"), "key"))
        equal = joined.where("lo = hi and n = 1")
        parts.append(equal.select("doc_id", "h", "start", (F.col("start") + F.length("body")).alias("end")))
        parts.append(_merged_spans(joined.where((F.col("lo") != F.col("hi")) & (F.col("m") <= MOST)), least, id_type))
        hot = joined.where((F.col("lo") != F.col("hi")) & (F.col("m") > MOST))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    out = outer.put(out)
    stage.clear()
    return out


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), least: int = 200, body: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the keep columns, a row for each row of docs; body adds kept (binary)."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    spans = repeated_spans(docs, doc_id, text, least)
    per_doc = spans.groupBy(F.col("doc_id").alias("s_id"), F.col("h").alias("s_h")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    own = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("h"), docs[text].alias("_text"), *[docs[c].alias(f"k_{i}") for i, c in enumerate(keep)])
    joined = own.join(per_doc, own["doc_id"].eqNullSafe(per_doc["s_id"]) & (own["h"] == per_doc["s_h"]), "left").select("doc_id", "_text", "spans", *[f"k_{i}" for i in range(len(keep))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_text", PIECE_BYTES):
                data, offsets = string_buffer(piece.column(1))
                lists = piece.column(2)
                sizes = np.asarray(lists.value_lengths().fill_null(0))
                row = np.repeat(np.arange(piece.num_rows), sizes)
                flat = lists.flatten()
                gone = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(gone, offsets[row] + np.asarray(flat.field(0)), 1)
                np.add.at(gone, offsets[row] + np.asarray(flat.field(1)), -1)
                removed = np.cumsum(gone)[:-1] > 0
                begin = removed & np.concatenate(([True], ~removed[:-1]))
                inner = offsets[:-1][offsets[:-1] < offsets[1:]]
                begin[inner] = removed[inner]
                sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[offsets])
                left = data[~removed].tobytes()
                ends = np.concatenate(([0], np.cumsum(~removed)))[offsets]
                texts = [left[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                columns = [piece.column(0), pa.array(np.diff(offsets)), pa.array(sums(removed)), pa.array(sums(begin)), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(texts, type=pa.binary())] if body else []), *(piece.column(3 + i) for i in range(len(keep)))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if body else []), *[f"k_{i}" for i in range(len(keep))]])

    kept_types = "".join(f", k_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = joined.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{', kept binary' if body else ''}{kept_types}")
    results = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if body else [])]
    return out.select(*results, *[F.col(f"k_{i}").alias(name) for i, (_, name) in enumerate(carried(keep, results))])
