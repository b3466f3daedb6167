"""Near-duplicate documents: MinHash, banding, exact verification, components.

The set of a document is its distinct shingles of ``width`` words (A-Z
lower-cased). Documents of equal sets (128 bits of XXH3 word hashes) are one
node. 200 universal hash minima make 40 bands of 5: a pair at similarity 0.8 is
missed with probability 1.3e-7. Candidate links are confirmed on full sets,
shingles compared by their characters.

A node is a set, not an id, so an id that several texts use joins nothing, and
ids may have any type that orders. Defined results: texts without words and
null texts have an empty set and are linked with nothing; a null id is never
the least of a component that has another, and its row is kept only where all
ids are null; equal rows get equal results; an empty table gives an empty
table; very long texts are read whole; columns named in ``keep`` are carried
(``carried`` names those that clash). The smallest id of a component is the
kept one; with ``single``, the column ``first`` marks one row of each
component, also where rows share the smallest id, and every row without words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm._common import BROADCAST_IDS, MULTIPLIERS, Stage, carried, exact_shingles, mix, shingles, signed, slices, string_buffer, word_hashes
from foliant.llm._lsh import Sets, band_keys, minima, similar_components

PIECE_BYTES = 1 << 20
BANDS, ROWS = 40, 5
LEAST_SHARE = 0.6  # of equal minima; at similarity 0.8 seven standard deviations below


def sets_of(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's shingles."""
    hashes, before = word_hashes(*string_buffer(column), fold=True)
    values, offsets = shingles(hashes[0], before, width)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def signatures(docs: DataFrame, text: str, doc_id: str, width: int, row: Column) -> DataFrame:
    """doc_id, row, h (of the text), n_shingles, g1, g2 (128 bits of the set), bands, signature."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_text", PIECE_BYTES):
                hashes, before = word_hashes(*string_buffer(piece.column(3)), fold=True)
                n = piece.num_rows
                keys, low, sums = np.zeros((n, BANDS), dtype=np.uint64), np.zeros((n, BANDS * ROWS), dtype=np.uint8), np.zeros((2, n), dtype=np.uint64)
                for k in (1, 0):  # the second half of each word's hash makes a second sum over the set
                    values, offsets = shingles(hashes[k], before, width)
                    sizes = np.diff(offsets)
                    some = np.flatnonzero(sizes)
                    if len(some):
                        sums[k, some] = mix(np.add.reduceat(mix(values * MULTIPLIERS[9 + k]), offsets[:-1][some]) + sizes[some].astype(np.uint64))
                if len(some):
                    minimal = minima(values, np.append(offsets[:-1][some], len(values)), BANDS * ROWS)
                    keys[some], low[some] = band_keys(minimal, BANDS, ROWS), (minimal & 0xFF).astype(np.uint8)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), signed(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(3)), pa.array(sizes), signed(sums[0]), signed(sums[1]), lists, pa.array([x.tobytes() for x in low], type=pa.binary())], ["doc_id", "row", "h", "n_shingles", "g1", "g2", "bands", "signature"])

    rows = docs.select(docs[doc_id].alias("doc_id"), row.alias("row"), F.xxhash64(docs[text]).alias("h"), docs[text].alias("_text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, row long, h long, n_shingles long, g1 long, g2 long, bands array<long>, signature binary")


def _judged(stage: Stage, source: DataFrame, id_name: str, text_name: str, width: int, percent: int, row: Column) -> DataFrame:
    """doc_id, row, h, n_shingles, component_id, first, kept of every row of source."""
    rows = stage.put(signatures(source, text_name, id_name, width, row), random=True)
    some = rows.where("n_shingles > 0")
    # the first row of each set, null ids last; its h finds the text again
    one = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), "row", "h"))
    groups = stage.put(some.groupBy("g1", "g2").agg(one.alias("one")).select("g1", "g2", "one.id", "one.row", "one.h"))
    # a node is named by half of its set's bits; of sets that share these, one is searched for links
    nodes = stage.put(groups.groupBy("g1").agg(F.min("g2").alias("g2")))
    named = some.select("g1", "g2", "bands", "signature", "row").join(groups.select("g1", "g2", "row"), ["g1", "g2", "row"]).join(nodes, ["g1", "g2"])
    items = stage.put(named.select(F.col("g1").alias("id"), "bands", "signature"), random=True)
    where = groups.join(nodes, ["g1", "g2"]).select(F.col("g1").alias("node"), "id", "h")

    def texts(ids: DataFrame) -> DataFrame:
        wanted = stage.put(where.join(stage.small(ids), F.col("node") == ids["id"], "left_semi").select("node", F.col("id").alias("_id"), F.col("h").alias("_h")))
        own = source.select(source[id_name].alias("own_id"), F.xxhash64(source[text_name]).alias("own_h"), source[text_name].alias("text"))
        found = own.join(stage.small(wanted), F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own_h") == F.col("_h")))
        return stage.put(found.select(F.col("node").alias("id"), "text").dropDuplicates(["id"]))

    sets = Sets(lambda column: sets_of(column, width), lambda column: exact_shingles(column, width))
    found = stage.put(similar_components(stage, items, texts, sets, percent, LEAST_SHARE, stage.rows(items) * BANDS).select(F.col("node").alias("g1"), "component").join(nodes, "g1"))
    # the groups of linked nodes, and of each component the least id and row
    linked = stage.put(groups.select("g1", "g2", "id", "row").join(stage.small(found), ["g1", "g2"]))
    first = F.min(F.struct(F.col("id").isNull(), F.col("id").alias("least"), F.col("row").alias("first_row")))
    least = stage.put(linked.groupBy("component").agg(first.alias("one")).select("component", "one.least", "one.first_row"))
    moved = stage.put(linked.join(stage.small(least), "component").select("g1", "g2", "least", "first_row"))
    settled = groups.select("g1", "g2", "id", "row").join(stage.small(moved), ["g1", "g2"], "left")
    settled = stage.put(settled.select("g1", "g2", F.when(F.col("first_row").isNull(), F.col("id")).otherwise(F.col("least")).alias("component"), F.coalesce("first_row", "row").alias("first_row")))
    judged = rows.select("doc_id", "row", "h", "n_shingles", "g1", "g2").join(settled, ["g1", "g2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    judged = judged.select("doc_id", "row", "h", "n_shingles", component.alias("component_id"), F.coalesce(F.col("row") == F.col("first_row"), F.col("n_shingles") == 0).alias("first"))
    return judged.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 80, keep: tuple[str, ...] = (), single: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, with single first, and the keep columns: one row for each row of docs."""
    stage = Stage(docs.sparkSession)
    if keep:  # the carried columns are joined back by a row number that is written once
        names = [f"c{i}" for i in range(len(docs.columns))]
        place = {c: n for n, c in zip(names, docs.columns, strict=True)}
        base = stage.put(docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id()))
        judged = _judged(stage, base, place[doc_id], place[text], width, percent, base["_row"])
    else:
        judged = _judged(stage, docs, doc_id, text, width, percent, F.monotonically_increasing_id())
    results = ["doc_id", "n_shingles", "component_id", "kept", *(["first"] if single else [])]
    if not keep:
        return judged.select(*results)
    joined = judged.join(base, F.col("row") == F.col("_row"))
    return joined.select(*results, *[F.col(place[c]).alias(name) for c, name in carried(keep, results)])


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, one of each component: the first of near_duplicates with single. Rows without words stay.

    Only what leaves is joined to docs: texts (id, hash) whose rows all go,
    and texts of which one of several equal rows stays.
    """
    stage = Stage(docs.sparkSession)
    judged = _judged(stage, docs, doc_id, text, width, percent, F.monotonically_increasing_id())
    marks = judged.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("first").cast("long")).alias("stay"))
    outer = Stage(docs.sparkSession)
    marks = outer.put(marks.where("stay < n"))
    stage.clear()
    numbers = docs.schema[doc_id].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")

    def chosen(df: DataFrame, of: DataFrame, how: str) -> DataFrame:
        of = F.broadcast(of) if numbers and outer.rows(marks) <= BROADCAST_IDS else of
        return df.join(of, df[doc_id].eqNullSafe(F.col("_id")) & (F.xxhash64(df[text]) == F.col("_h")), how)

    gone, several = marks.where("stay = 0"), marks.where("stay > 0")
    left = chosen(docs, gone, "left_anti")
    if several.limit(1).count() == 0:
        return left
    one = chosen(left, several, "left_semi").withColumn("_h", F.xxhash64(left[text])).dropDuplicates([doc_id, "_h"]).drop("_h")
    return chosen(left, several, "left_anti").unionByName(one)
