"""Similar pairs by MinHash banding, exact verification, and their components.

Candidates are never all pairs of a bucket. A bucket first gives the links of
its members to its least and its greatest member; these are verified and the
components found. Only buckets that still hold several components are looked
at again: there, and only across components, members are compared in blocks of
bounded size, by their signatures and then on full sets.

Open buckets of more than ``MOST`` members are not compared whole. Their
members go by their rarest shingles instead: a set of n shingles gives those
of its first n - ceil(percent * n / 100) + 1 in the order of frequency among
such members. Two sets at the threshold or above share one of them (prefix
filtering), so no pair is lost, and members that share a frequent template
only never meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm._common import Stage, _odd, jaccard_parts, mix, slices
from foliant.llm._components import connected

_U = np.uint64
BLOCK, MOST = 512, 4096
_A, _B = _odd(512), _odd(512)


def minima(values: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """n universal hash minima (uint32) of each non-empty set of 64-bit values."""
    out = np.empty((len(offsets) - 1, n), dtype=np.uint32)
    starts = offsets[:-1]
    buffer = np.empty(len(values), dtype=_U)
    for k in range(n):
        np.multiply(values, _A[k], out=buffer)
        np.add(buffer, _B[k], out=buffer)
        out[:, k] = np.minimum.reduceat(buffer, starts) >> _U(32)
    return out


def binned_minima(values: np.ndarray, owner: np.ndarray, n_sets: int, n: int) -> np.ndarray:
    """One-permutation MinHash (uint32): the least hash in each of n bins; empty bins copy a bin found by universal hashing."""
    empty = np.uint64(2**64 - 1)
    h = values * _A[300]
    h ^= h >> _U(32)
    h *= _A[301]
    cell = (h >> _U(32)) * _U(n)
    cell >>= _U(32)
    cell += owner.astype(_U) * _U(n)
    out = np.full(n_sets * n, empty, dtype=_U)
    np.minimum.at(out, cell.view(np.int64), h)
    out = out.reshape(n_sets, n)
    full = out != empty
    row, col = np.nonzero(~full)
    attempt = 0
    while len(row):
        attempt += 1  # which bin an empty one copies depends on the bin and the attempt alone
        to = ((mix(np.arange(n, dtype=_U) * _A[302] + _U(attempt * 2654435761)) >> _U(32)).astype(np.int64) % n)[col]
        good = full[row, to]
        out[row[good], col[good]] = out[row[good], to[good]]
        row, col = row[~good], col[~good]
        if attempt > 64 * n:
            break
    return (out * _A[303] >> _U(32)).astype(np.uint32)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band."""
    keys = np.zeros((len(signature), bands), dtype=_U)
    for k in range(rows):
        keys += signature[:, k : bands * rows : rows].astype(_U) * _A[400 + k]
    return mix(keys + np.arange(1, bands + 1, dtype=_U)[None, :] * _B[400])


@dataclass
class Sets:
    """Two ways to make the sorted distinct shingles of each text of a column.

    hashed: 64-bit hashes, comparable everywhere. exact: numbers that are
    equal for equal shingles of one call, told apart by their characters.
    certain: given where the hashes are the cheaper way and sort out pairs
    first; whether a text's hashes name its shingles one to one, so that two
    such texts need no exact sets.
    """

    hashed: Callable[[pa.Array], list[np.ndarray]]
    exact: Callable[[pa.Array], list[np.ndarray]]
    certain: Callable[[pa.Array], np.ndarray] | None = None


def similar_pairs(column: pa.Array, left: np.ndarray, right: np.ndarray, sets: Sets, percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union of texts left[k] and right[k] of a column; never by hashes alone."""
    good = np.ones(len(left), dtype=bool)
    named = column.dictionary_encode()  # a text that is in many pairs is looked at once
    column, number = named.dictionary, np.asarray(named.indices.fill_null(-1))
    left, right = number[left], number[right]
    good &= (left >= 0) & (right >= 0)
    sure = sets.certain(column) if sets.certain else None
    for make in (sets.exact,) if sure is None else (sets.hashed, sets.exact):
        at = np.flatnonzero(good if make is sets.hashed or sure is None else good & ~(sure[left] & sure[right]))
        if not len(at):
            break
        used, where = np.unique(np.concatenate((left[at], right[at])), return_inverse=True)
        own = make(column.take(pa.array(used)))
        for k, i, j in zip(at.tolist(), where[: len(at)].tolist(), where[len(at) :].tolist(), strict=True):
            x, y = own[i], own[j]
            good[k] = len(x) > 0 and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y))
            if good[k]:
                shared, union = jaccard_parts(x, y)
                good[k] = 100 * shared >= percent * union
    return good


def verify(pairs: DataFrame, texts: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar on full sets. texts: id, text."""
    first, second = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text_a", 1 << 19):
                n = np.arange(batch.num_rows)
                keep = pa.array(similar_pairs(pa.concat_arrays([batch.column(2), batch.column(3)]), n, n + batch.num_rows, sets, percent))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def agreeing(pairs: DataFrame, signatures: DataFrame, least_share: float) -> DataFrame:
    """Signature verification: the pairs (a, b) that agree in least_share of the minima at least. signatures: id, signature."""
    first, second = signatures.select(F.col("id").alias("a"), F.col("signature").alias("x")), signatures.select(F.col("id").alias("b"), F.col("signature").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                keep = pa.array((x == y).mean(axis=1) >= least_share)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def key_parts(n_keys: int) -> int:
    """Ranges of keys, about a million in each."""
    return min(1 << 22, max(64, n_keys // 1_000_000))


def key_code(key: Column, parts: int) -> Column:
    """The range of a key and its low 40 bits, as repeated_keys names keys."""
    part = F.shiftrightunsigned(F.shiftrightunsigned(key, 32) * F.lit(parts), 32)
    return F.shiftleft(part, 40).bitwiseOR(key.bitwiseAND(F.lit((1 << 40) - 1)))


def repeated_keys(items: DataFrame, parts: int) -> DataFrame:
    """code: the codes of band keys of at least two ids. items: id, bands.

    Most keys are single, so they travel packed in 8 bytes: a task sorts its
    batch, drops what repeats in it, and sends a few blobs by ranges of the
    key. A frequent key comes once or twice a batch. A code that two keys
    share lets both through, no more; the id's 24 bits tell equal ids apart.
    """
    high = _U(0xFFFFFF0000000000)  # 40 bits of the key within its range, 24 of the id above them

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            keys = np.asarray(lists.flatten()).view(_U)
            part = ((keys >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
            ids = np.repeat(mix(np.asarray(batch.column(0)).view(_U)), np.asarray(lists.value_lengths()))
            short = keys & ~high
            order = np.argsort((part << 40).view(_U) | short)  # which of equal keys comes first does not matter
            part, short, ids = part[order], short[order], ids[order] & high
            new = np.concatenate(([True], (short[1:] != short[:-1]) | (part[1:] != part[:-1]))) if len(keys) else np.zeros(0, dtype=bool)
            if not new.all():  # of a key that repeats: its first id and one that differs from it
                first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
                group, take = np.cumsum(new), np.flatnonzero(ids != ids[first])
                kept = np.sort(np.concatenate((np.flatnonzero(new), take[np.unique(group[take], return_index=True)[1]])))
                part, short, ids = part[kept], short[kept], ids[kept]
            packed = ids | short
            cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int32)), pa.array([packed[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], type=pa.binary())], ["part", "blob"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(part: int, blobs: list[bytes]) -> pa.RecordBatch:
            packed = np.frombuffer(b"".join(blobs), dtype=_U)
            packed = packed[np.argsort(packed & ~high)]
            keys, ids = packed & ~high, packed & high
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            several = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
            return pa.RecordBatch.from_arrays([pa.array((keys[starts[several]] | _U(part) << _U(40)).view(np.int64))], ["code"])

        held, last = [], -1
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != last and held:
                    yield found(last, held)
                    held = []
                held.append(blob)
                last = part
        if held:
            yield found(last, held)

    blobs = items.select("id", "bands").mapInArrow(pack, "part int, blob binary")
    return blobs.repartition("part").sortWithinPartitions("part").mapInArrow(count, "code long")


def across(members: DataFrame, sets: Sets, percent: int, least_share: float) -> DataFrame:
    """a, b: links between members of one block and different components, confirmed on full sets.

    members: key, i, j (the block), band (the key's own, -1 if it is a shingle), id,
    component, side, bands, signature (binary, a byte a minimum), text. A pair
    is looked at in the first band that it shares, if its signatures agree in
    least_share of the minima; components that a link joins need no other, so
    a block gives fewer links than it has members.
    """
    names = ("key", "i", "j", "band", "id", "component", "side", "bands", "signature", "text")
    ordered = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def links(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows).combine_chunks()
        keys = np.stack([np.asarray(t.column(c)) for c in names[:3]])
        cut = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [t.num_rows]))
        ids, every, side = (np.asarray(t.column(c)) for c in ("id", "component", "side"))
        signature = np.frombuffer(b"".join(t.column("signature").to_pylist()), dtype=np.uint8).reshape(t.num_rows, -1)
        lists = pa.concat_arrays(t.column("bands").chunks) if t.num_rows else pa.array([], type=pa.list_(pa.int64()))
        bands = np.asarray(lists.flatten()).reshape(t.num_rows, -1)
        band = np.asarray(t.column("band"))
        text = pa.concat_arrays(t.column("text").chunks)
        found = []
        for at, to in zip(cut[:-1], cut[1:], strict=True):
            comps = every[at:to].copy()
            same_block = keys[1, at] == keys[2, at]
            if to - at < 2 or (comps == comps[0]).all():
                continue
            own = None
            left = np.flatnonzero(side[at:to] == 0)
            right = left if same_block else np.flatnonzero(side[at:to] == 1)
            for some in (left[k : k + 64] for k in range(0, len(left), 64)):
                equal = (signature[at + some][:, None, :] == signature[at + right][None, :, :]).sum(axis=2, dtype=np.int16)
                meet = (equal >= least_share * signature.shape[1]) & (comps[some][:, None] != comps[right][None, :])
                if same_block:
                    meet &= right[None, :] > some[:, None]
                x, y = (i[j] for i, j in zip((some, right), np.nonzero(meet), strict=True))
                if band[at] >= 0:
                    first = (bands[at + x] == bands[at + y]).argmax(axis=1) == band[at]
                    x, y = x[first], y[first]
                for x, y in zip(x.tolist(), y.tolist(), strict=True):
                    if comps[y] == comps[x]:
                        continue
                    if own is None:
                        own = (sets.hashed if sets.certain else sets.exact)(text.slice(at, to - at))
                    shared, union = jaccard_parts(own[x], own[y])
                    if 100 * shared >= percent * union and (not sets.certain or similar_pairs(text.take(pa.array([at + x, at + y])), np.array([0]), np.array([1]), sets, percent)[0]):
                        found.append((ids[at + x], ids[at + y]))
                        comps[comps == comps[y]] = comps[x]
        both = np.array(found, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of one block (2 * BLOCK at most) and of a slice
        last = None
        for whole in batches:
            for batch in (whole.slice(k, BLOCK) for k in range(0, whole.num_rows, BLOCK)):
                key = np.stack([np.asarray(batch.column(k)) for k in range(3)])
                change = np.flatnonzero(np.concatenate(([last is None or bool((key[:, 0] != last).any())], (key[:, 1:] != key[:, :-1]).any(axis=0))))
                if len(change):
                    if change[-1]:
                        held.append(batch.slice(0, int(change[-1])))
                    if held:
                        yield from links(held)
                    held = []
                held.append(batch.slice(int(change[-1]) if len(change) else 0))
                last = key[:, -1]
        if held:
            yield from links(held)

    return ordered.select(*names).mapInArrow(run, "a long, b long").distinct()


def rarest(stage: Stage, hot: DataFrame, bodies: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """key, id, component: the prefix of each member's shingles, those that another component has too. hot: id, component."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 18):
                own = sets.hashed(batch.column(2))
                sizes = np.array([len(x) for x in own], dtype=np.int64)
                row = pa.array(np.repeat(np.arange(len(own)), sizes))
                values = np.concatenate(own) if own else np.zeros(0, dtype=_U)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(values.view(np.int64)), pa.array(np.repeat(sizes, sizes))], ["id", "component", "key", "size"])

    tokens = stage.put(hot.join(bodies, "id").select("id", "component", "text").mapInArrow(spread, "id long, component long, key long, size long"))
    often = stage.put(tokens.groupBy("key").agg(F.count(F.lit(1)).alias("f"), F.min("component").alias("x"), F.max("component").alias("y")).where("f > 1"))
    ranked = tokens.join(often, "key", "left").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("f", F.lit(1)), "key")))
    return ranked.where((F.col("place") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1) & (F.col("x") < F.col("y"))).select("key", "id", "component")


def dealt(stage: Stage, groups: DataFrame) -> DataFrame:
    """key, i, j, side, banded, id, component: the members of each group in all blocks to compare. groups: a table of key, id, component, banded.

    A group of BLOCK members is one block. Of a larger one, the members of its
    largest component need no comparison with each other: they are cut into
    blocks, as the others are, and each block of others meets all blocks.
    """
    each = groups.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = stage.put(each.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", "n").alias("main")).where("n > most"))
    rows = groups.join(stage.small(sizes), "key")
    one, main = F.col("n") <= BLOCK, F.col("component") == F.col("main")
    others = F.when(one, 1).otherwise(F.ceil((F.col("n") - F.col("most")) / BLOCK)).cast("long")
    mains = F.when(one, 0).otherwise(F.ceil(F.col("most") / BLOCK)).cast("long")
    rows = rows.withColumns({"others": others, "mains": mains, "main": main & ~one})
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1 + F.when(F.col("main"), F.lit(0)).otherwise(F.col("mains")))))
    own = F.when(F.col("main"), F.col("others")).otherwise(F.lit(0)) + F.col("own")
    return rows.select("key", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), (own > F.col("other")).cast("int").alias("side"), "banded", "id", "component")


def _kept(outer: Stage, stage: Stage, df: DataFrame) -> DataFrame:
    out = outer.put(df)
    stage.clear()
    return out


def similar_components(stage: Stage, items: DataFrame, texts: Callable[[DataFrame], DataFrame], sets: Sets, percent: int, least_share: float, n_keys: int) -> DataFrame:
    """node, component of every item that is linked with another, as a table of the stage.

    items: id (long, one row an id or several alike), bands (array<long>),
    signature (binary); n_keys: about as many band keys. texts: gets a table of ids and gives
    a table of id, text of those, once an id.
    """
    outer, stage = stage, Stage(items.sparkSession)  # its tables go when the result is written
    parts = key_parts(n_keys)
    shared = stage.put(repeated_keys(items, parts))
    keyed = items.select("id", F.explode("bands").alias("key")).withColumn("code", key_code(F.col("key"), parts))
    members = stage.put(keyed.join(stage.small(shared), "code", "left_semi").select("id", "key").distinct())
    # written first: a join with the aggregate itself would keep its partitioning, and a large bucket in one task
    buckets = stage.put(members.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi"))
    stars = members.join(stage.small(buckets), "key")
    star = stars.select("lo", F.col("id").alias("hi")).union(stars.select(F.col("id"), F.col("hi")))
    pairs = stage.put(star.where("lo <> hi").select(F.least("lo", "hi").alias("a"), F.greatest("lo", "hi").alias("b")).distinct())
    ids = stage.put(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    # written, as it is joined to hubs with many pairs, which are split then
    marks = stage.put(items.select("id", "signature").join(stage.small(ids), "id", "left_semi").dropDuplicates(["id"]))
    pairs = stage.put(agreeing(pairs, marks, least_share))

    # the texts that any later step may compare, read once: ends of pairs, and members of buckets that stars do not cover
    wide = stage.put(buckets.where("n > 3").select("key"))
    ends = stage.put(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(members.join(stage.small(wide), "key", "left_semi").select("id")).distinct())
    bodies = texts(ends)
    links = stage.put(verify(pairs, bodies, sets, percent))
    stage.drop(shared, ids, marks)
    found = connected(stage, links)
    placed = members.join(stage.small(wide), "key", "left_semi").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    # of three members the stars are all pairs
    opened = stage.put(placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y").select("key", "n"))
    if not stage.rows(opened):
        return _kept(outer, stage, found)
    rest = stage.put(placed.select("key", "id", "component").join(stage.small(opened), "key"))
    groups = rest.where(F.col("n") <= MOST).select("key", "id", "component", F.lit(True).alias("banded"))
    hot = stage.put(rest.where(F.col("n") > MOST).select("id", "component").distinct())
    if stage.rows(hot):
        groups = groups.unionByName(rarest(stage, hot, bodies, sets, percent).withColumn("banded", F.lit(False)))
    groups = stage.put(groups)
    chosen = stage.put(groups.select("id").distinct())
    marked = items.select("id", "signature", "bands").join(stage.small(chosen), "id", "left_semi").dropDuplicates(["id"])
    marked = stage.put(marked.join(bodies, "id"))
    more = stage.put(across(dealt(stage, groups).join(marked, "id").withColumn("band", F.when(F.col("banded"), F.array_position("bands", F.col("key")).cast("int") - 1).otherwise(-1)), sets, percent, least_share))
    if stage.rows(more):
        found = connected(stage, found.where("node <> component").toDF("a", "b").union(more))
    return _kept(outer, stage, found)
