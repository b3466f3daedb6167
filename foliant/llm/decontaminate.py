"""Benchmark decontamination: containment search for short items inside long documents.

Items are put into size classes by powers of two of their number of distinct
five-word shingles. An item's signature is its smallest min-wise hashes: as
many as the largest item of its class may lack at the threshold, plus one. By
counting, every document that contains the threshold share of the item's
shingles holds one of them, however long the document is, so the search has
recall 1. A document is searched for the classes that it can contain only: its
own signature is its shingle hashes up to the largest hash in the signatures of
these classes. Hashes are 64-bit numbers; pairs that share one are candidates,
and these are verified by exact containment of whole shingle strings.

Signatures are broadcast only if they are at most ``broadcast_rows`` rows of
three numbers (a checked bound), shingle strings only if they are at most
``broadcast_bytes`` too; otherwise the joins shuffle, with the same result.
Long texts are cut into pieces of ``CHUNK`` shingles. Only DataFrame functions
are used. The only rows that reach the driver are the size classes', 64 at most.

Defined results: null and blank texts, and items or documents of fewer than
five words, match nothing; documents are told apart by id and text, so
repeated rows count once; equal items all match, also with equal ids; null ids
are ids; very long texts are searched whole; empty tables give no matches;
extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm._common import Stage, lower_ascii, words

WIDTH = 5
CHUNK = 4096


def _shingled(df: DataFrame, text: str, width: int) -> DataFrame:
    """df with w (words) and n_positions (shingles with repeats), without texts that have none."""
    # out of a generator: conditions on w below it would split the text again for each mention
    made = df.withColumn("w", F.explode(F.array(words(lower_ascii(F.coalesce(text, F.lit("")))))))
    return made.withColumn("n_positions", F.size("w") - (width - 1)).where("n_positions > 0")


def _exploded(df: DataFrame, keys: list[str], width: int, strings: bool) -> DataFrame:
    """keys, h: a row for each shingle position; with strings also shingle. df: w, n_positions."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.col("n_positions") - 1) / CHUNK).cast("int")), lambda c: F.slice("w", c * CHUNK + 1, F.lit(CHUNK + width - 1)))
    chunks = F.when(F.col("n_positions") <= CHUNK, F.array("w")).otherwise(cut)
    pieces = df.select(*keys, F.explode(chunks).alias("w"))
    n = F.size("w") - (width - 1)
    zipped = F.arrays_zip(*[F.slice("w", k + 1, n).alias(f"w{k}") for k in range(width)])
    rows = pieces.select(*keys, F.explode(zipped).alias("z"))
    own = [F.col(f"z.w{k}") for k in range(width)]
    return rows.select(*keys, F.xxhash64(*own).alias("h"), *([F.concat_ws(" ", *own).alias("shingle")] if strings else []))


def signatures(pieces: DataFrame, percent: int) -> DataFrame:
    """no, n_item, class, h: the smallest min-wise hashes of each item, by size class.

    pieces: no, h, shingle, distinct. An item's shingles are an item's text: bounded.
    """
    sized = pieces.groupBy("no").agg(F.count(F.lit(1)).alias("n_item"), F.array_sort(F.collect_list("h")).alias("s")).withColumn("class", F.floor(F.log2("n_item")))
    largest = F.pow(F.lit(2.0), F.col("class") + 1).cast("long") - 1  # of the class
    minima = largest - F.ceil(largest * percent / 100) + 1
    return sized.select("no", "n_item", "class", F.explode(F.slice("s", F.lit(1), minima.cast("int"))).alias("h"))


def largest_hash(signature: DataFrame, percent: int) -> Column:
    """The largest hash in the signatures of the classes that a document of n_positions can contain; null if there are none."""
    classes = signature.groupBy("class").agg(F.min("n_item").alias("least"), F.max("h").alias("h")).collect()
    upto = [F.when(100 * F.col("n_positions") >= percent * c["least"], F.lit(c["h"])) for c in classes]
    return reduce(F.greatest, upto, F.lit(None).cast("long"))


def containment_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = 80, width: int = WIDTH, broadcast_rows: int = 500_000, broadcast_bytes: int = 1 << 26) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment, text_hash: pairs with 100 * n_shared >= percent * n_item."""
    stage = Stage(docs.sparkSession)
    items = stage.put(benchmark.select(F.monotonically_increasing_id().alias("no"), benchmark[item_id].alias("item"), benchmark[item_text].alias("_text")))
    pieces = stage.put(_exploded(_shingled(items, "_text", width), ["no"], width, True).distinct())
    signature = stage.put(signatures(pieces, percent))
    probe = signature.select("no", "n_item", "h")
    probe = F.broadcast(probe) if stage.rows(signature) <= broadcast_rows else probe

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("_text")).withColumn("text_hash", F.xxhash64("_text"))
    searched = _shingled(rows, "_text", width).withColumn("upto", largest_hash(signature, percent)).where("upto is not null")
    spread = _exploded(searched, ["doc_id", "text_hash", "n_positions", "upto"], width, False).where("h <= upto")
    hits = spread.join(probe, "h").where(100 * F.col("n_positions") >= percent * F.col("n_item"))
    candidates = stage.put(hits.select("doc_id", "text_hash", "no", "n_item").distinct())

    held = stage.put(candidates.select("text_hash").distinct())
    chosen = rows.join(F.broadcast(held) if stage.rows(held) <= broadcast_rows else held, "text_hash", "left_semi")
    own = _exploded(_shingled(chosen, "_text", width), ["doc_id", "text_hash"], width, True)
    wanted = pieces.select("no", "h", "shingle")
    if stage.rows(pieces) <= broadcast_rows and (wanted.agg(F.sum(F.octet_length("shingle"))).first()[0] or 0) <= broadcast_bytes:
        wanted = F.broadcast(wanted)
    counted = own.join(wanted, ["h", "shingle"]).distinct().groupBy("doc_id", "text_hash", "no").agg(F.count(F.lit(1)).alias("n_shared"))
    c = candidates.alias("c")
    out = counted.join(c, counted["doc_id"].eqNullSafe(F.col("c.doc_id")) & (counted["text_hash"] == F.col("c.text_hash")) & (counted["no"] == F.col("c.no")))
    out = out.where(100 * F.col("n_shared") >= percent * F.col("c.n_item")).join(items.select(F.col("no").alias("item_no"), "item"), counted["no"] == F.col("item_no"))
    return out.select(counted["doc_id"], F.col("item").alias("item_id"), F.col("c.n_item").alias("n_item"), "n_shared", F.round(F.col("n_shared") / F.col("c.n_item"), 6).alias("containment"), counted["text_hash"])
