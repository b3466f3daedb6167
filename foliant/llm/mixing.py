"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's texts, in the order of a hash, form a stream of words, read
``max_repeats`` times at most and cut into blocks of ``block_words`` words.
Slot t of the schedule has the golden-ratio point frac((t + 1) * phi); the
cumulative target shares map it to a source. The k-th slot of a source takes
the k-th block of its stream. As the points fill the unit interval evenly,
any prefix of the schedule is mixed nearly to the targets.

All ranks and stream positions are two-level prefix sums: totals of hash
ranges (or slot ranges) are summed over the ranges of each source, then rows
within a range. There are about as many ranges as rows in a range (the square
root of all rows), so a source with a third of all rows is spread over many
tasks. One row a source, no more, meets in one task (``source_targets``). Only
DataFrame functions are used.

Defined results: null and blank texts have no words and are never taken; null
is a source of its own, ordered last; null ids are ids; repeated rows (equal
source, id and text) are separate texts, numbered, and which of them has which
number changes no result, so the result does not depend on how the table is
split; very long texts are counted whole; an empty table gives an empty table;
columns named in ``keep`` are carried (``carried`` names those that clash).
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm._common import Stage, carried, n_words

#: The golden ratio's fraction as a 62-bit fixed-point number: floor(2 ** 62 * (sqrt(5) - 1) / 2).
GOLDEN_62 = 2850178443634021189
CELLS = 4096
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, max_repeats: int = 2) -> DataFrame:
    """source, source_size, weight, target, share_from, share_to: one row for each source.

    sizes: source, size. Shares by weight; a source is held at max_repeats
    times its size and the excess is shared again until none is above. In the
    order of capacity over weight, source i is held exactly if the level
    reached without it, (total - capacities before) / (weights from i on),
    gives it more than its capacity: levels rise up to the first source that
    is not held and fall from there, so the largest is the final one.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row a source from here on
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = total.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("capacity", F.lit(float(max_repeats)) * F.col("source_size"))
    fill = Window.orderBy((F.col("capacity") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumns(
        {
            "held_before": F.sum("capacity").over(fill.rowsBetween(Window.unboundedPreceding, -1)),
            "weight_left": F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(whole) * (percent / 100.0),
        }
    )
    level = (F.col("total") - F.coalesce("held_before", F.lit(0.0))) / F.col("weight_left")
    ranked = ranked.withColumn("level", F.when(level * F.col("weight") <= F.col("capacity"), level))
    ranked = ranked.withColumn("level", F.max("level").over(whole))
    ranked = ranked.withColumn("target", F.least("capacity", F.coalesce(F.col("level") * F.col("weight"), F.col("capacity"))))
    upto = F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    every = F.sum("target").over(whole)
    ranked = ranked.withColumns({"_to": upto, "_all": every, "_n": F.row_number().over(by_name), "_of": F.count(F.lit(1)).over(whole)})
    return ranked.select(
        "source", "source_size", "weight", "target", F.when(F.col("_all") > 0, (F.col("_to") - F.col("target")) / F.col("_all")).otherwise(0.0).alias("share_from"),
        F.when(F.col("_n") == F.col("_of"), F.lit(1.5)).when(F.col("_all") > 0, F.col("_to") / F.col("_all")).otherwise(0.0).alias("share_to"),
    )


def before_in_range(df: DataFrame, key: str, place: Column, order: list[Column], amount: Column, name: str) -> DataFrame:
    """df with the sum of amount over all earlier rows of the same key.

    place: an integer that grows with the order and of which a key has a
    bounded number of values, each with a bounded number of rows.
    """
    df = df.withColumn("_place", place).withColumn("_amount", amount)
    totals = df.groupBy(key, "_place").agg(F.sum("_amount").alias("_total"))
    earlier = Window.partitionBy(key).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(key).alias("_key"), F.col("_place").alias("_there"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    joined = df.join(totals, df[key].eqNullSafe(totals["_key"]) & (df["_place"] == totals["_there"]))
    within = Window.partitionBy(key, "_place").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(name, F.col("_base") + F.coalesce(F.sum("_amount").over(within), F.lit(0))).drop("_place", "_amount", "_key", "_there", "_base")


def golden_point(t: Column) -> Column:
    """frac((t + 1) * phi) from 62-bit fixed-point products in 31-bit limbs: nothing overflows, whatever t is."""
    mask = (1 << 31) - 1
    g0, g1 = GOLDEN_62 & mask, GOLDEN_62 >> 31
    low, high = (t + 1).bitwiseAND(F.lit(mask)), F.shiftright(t + 1, 31)
    carried = (low * F.lit(g1) + high * F.lit(g0)).bitwiseAND(F.lit(mask))
    return (low * F.lit(g0) + F.shiftleft(carried, 31)).bitwiseAND(F.lit((1 << 62) - 1)) / F.lit(float(1 << 62))


def slots(spark: SparkSession, n: int, shares: DataFrame, parts: int) -> DataFrame:
    """slot, source_no, slot_rank: the schedule's n slots, each with its rank among its source's.

    shares: source_no, share_from, share_to; a source is found by the cell of
    the unit interval, so that only an equi-join of a few rows a slot is made;
    there are more cells than sources.
    """
    n_sources = shares.count()
    cells_in_all = max(CELLS, 4 * n_sources)
    cell = lambda x: F.least(F.lit(cells_in_all - 1), F.floor(x * cells_in_all)).cast("int")
    cells = shares.where("share_to > share_from").withColumn("cell", F.explode(F.sequence(cell(F.col("share_from")), cell(F.col("share_to")))))
    points = spark.range(0, n, 1, parts).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point")).withColumn("cell", cell(F.col("point")))
    # a row for each source and for each cell: the sources' number is what bounds it
    found = points.join(F.broadcast(cells) if n_sources <= 100_000 else cells, "cell").where("point >= share_from and point < share_to")
    chunk = max(2048, isqrt(n))
    return before_in_range(found.select("slot", "source_no"), "source_no", F.floor(F.col("slot") / chunk), [F.col("slot")], F.lit(1), "slot_rank")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", keep: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, percent: int = 150, max_repeats: int = 2, block_words: int = 128, schedule: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken and the keep columns of every row of docs.

    taken: words that the schedule's blocks hold of the row, all repeats
    counted, so at most max_repeats * size. schedule=True gives the schedule
    itself instead: slot, source, slot_rank, doc_id, from_word, n_words.
    """
    spark = docs.sparkSession
    stage = Stage(spark)
    sizes = stage.put(docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), n_words(docs[text]).alias("size"), F.xxhash64(docs[source], docs[doc_id], docs[text]).alias("ident"), F.monotonically_increasing_id().alias("row"), *[docs[c].alias(f"k_{i}") for i, c in enumerate(keep)]))
    targets = stage.put(source_targets(sizes, weights, percent, max_repeats).withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    total, n_bytes = targets.agg(F.sum("target"), F.sum(F.octet_length(F.col("source").cast("string")))).first()
    few = stage.rows(targets) <= 100_000 and (n_bytes or 0) <= 1 << 24
    known = sizes.join(F.broadcast(targets) if few else targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    n = round((total or 0.0) / block_words)
    # equal rows are numbered, by the parts of the table they lie in and then within; others have number 0
    several = stage.put(sizes.groupBy("ident").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ident"))
    used = known.where("size > 0")
    numbered = used.join(stage.small(several), "ident", "left_anti").withColumn("copy", F.lit(0).cast("long"))
    if stage.rows(several):
        again = stage.put(used.join(stage.small(several), "ident", "left_semi"))
        numbered = numbered.unionByName(before_in_range(again, "ident", F.shiftright("row", 33), [F.col("row")], F.lit(1), "copy").withColumn("copy", F.col("copy").cast("long")))
    hashed = numbered.withColumn("hash", F.xxhash64(F.lit("order"), "ident", "copy"))
    ranges = max(16, isqrt(stage.rows(sizes)))
    streamed = before_in_range(hashed, "source_no", F.pmod(F.shiftrightunsigned("hash", 1), F.lit(ranges)), [F.col("hash"), F.col("ident"), F.col("copy")], F.col("size"), "start")
    passes = F.sequence(F.lit(0), F.lit(max_repeats - 1))
    spans = streamed.select("row", "doc_id", "source_no", "size", "start", "source_size", F.explode(passes).alias("turn"))
    spans = spans.withColumn("start", F.col("start") + F.col("turn") * F.col("source_size"))
    blocks = spans.select("*", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))).alias("block"))
    edges = (F.greatest("start", F.col("block") * block_words), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words))
    plan = slots(spark, n, targets, max(8, n // 500_000))
    chosen = blocks.join(plan, (blocks["source_no"] == plan["source_no"]) & (blocks["block"] == plan["slot_rank"])).drop(plan["source_no"])
    if schedule:
        named = chosen.join(targets.select("source_no", "source"), "source_no")
        return named.select("slot", "source", "slot_rank", "doc_id", (edges[0] - F.col("start")).alias("from_word"), (edges[1] - edges[0]).alias("n_words"))
    taken = chosen.groupBy("row").agg(F.sum(edges[1] - edges[0]).alias("taken"))
    out = known.join(taken, "row", "left")
    results = ["doc_id", "size", "source_size", "target", "taken"]
    return out.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).select(*results, *[F.col(f"k_{i}").alias(name) for i, (_, name) in enumerate(carried(keep, results))])
