"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are the presence of hashed words and of their 4- and 5-byte starts
(letters and digits only, A-Z lower-cased). The model is P(grade <= k) =
logistic(threshold_k - w.x) with one weight vector for all ordered thresholds;
the output is the expected grade. It is fitted on at most ``max_per_grade``
labelled texts of each grade, the ones with the smallest id hashes; features
are selected by a z score (more frequent above grade 0) on that sample, in a
pass of its own, so that at most ``most_features`` numbers a sampled text reach
the driver. Grades are 0 to ``top_grade``; higher ones count as that. Scoring
covers every text whole, in Arrow batches, with a table of 2 ** 18 weights.

Defined results: null and empty texts have no features and get the grade the
thresholds alone give; without labels above grade 0 every severity is 0, with
none of grade 0 every text's is 1; null and negative grades and null ids label nothing; a text that
is labelled twice, or whose id several texts have, counts each time; of labels
with equal id hashes the lesser id comes first; repeated rows are scored alike;
very long texts are read whole; an empty table gives an empty table; extra
columns are ignored unless named in ``keep`` (``carried`` names those that clash).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm._common import _LOWER_TABLE, MULTIPLIERS, Stage, carried, prefix_sums, slices, span_hash, string_buffer

BITS = 18
PIECE_BYTES = 1 << 22
_LETTER = np.zeros(256, dtype=bool)
_LETTER[128:] = True
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
STARTS = (4, 5)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature number of every word's features, repeats included, by row."""
    data, offsets = string_buffer(column)
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    letter = _LETTER[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.concatenate(([False], letter[:-1])) & ~cut[:-1]
    after = np.concatenate((letter[1:], [False])) & ~cut[1:]
    starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    prefix = prefix_sums(_LOWER_TABLE[data])
    shift = np.uint64(64 - BITS)
    hashes, at = [span_hash(prefix, starts, ends)], [starts]
    for n in STARTS:
        long = ends - starts > n
        hashes.append(span_hash(prefix, starts[long], starts[long] + n) * MULTIPLIERS[n])
        at.append(starts[long])
    rows = [np.searchsorted(offsets, x, side="right") - 1 for x in at]
    row, number = np.concatenate(rows), (np.concatenate(hashes) >> shift).astype(np.int64)
    return row, number


@dataclass
class Model:
    weights: np.ndarray  # of all 2 ** BITS features
    thresholds: np.ndarray
    toxic_from: float = 0.5  # least P(grade > 0) of a toxic text

    def grades(self, score: np.ndarray) -> np.ndarray:
        """P(grade = k) by row."""
        upto = 1 / (1 + np.exp(-(self.thresholds[None, :] - score[:, None])))
        upto = np.concatenate((np.zeros((len(score), 1)), upto, np.ones((len(score), 1))), axis=1)
        return np.diff(upto, axis=1)

    def scores(self, column: pa.Array) -> np.ndarray:
        row, number = features(column)
        used = self.weights[number] != 0
        pairs = np.unique(row[used] << BITS | number[used])
        return np.bincount(pairs >> BITS, self.weights[pairs & ((1 << BITS) - 1)], minlength=len(column))


def fit(row: np.ndarray, number: np.ndarray, grade: np.ndarray, chosen: np.ndarray, decay: float = 1e-4, steps: int = 400, rate: float = 0.1) -> Model:
    """Maximum likelihood with an L2 penalty, by Adam over the whole sample.

    row, number: distinct pairs; grade: of each row, 0 and up, 0 and another one
    at least; chosen: the features that have weights.
    """
    n, top = len(grade), int(grade.max())
    weights, high = np.zeros(1 << BITS), grade > 0
    index = np.full(1 << BITS, -1, dtype=np.int64)
    index[chosen] = np.arange(len(chosen))
    inside = index[number] >= 0
    r, c = row[inside], index[number[inside]]
    if top == 1:
        marks = np.bincount(r, minlength=n)
        grade = np.where(high & (marks > np.median(marks[high])), 2, grade)
        top = int(grade.max())
    w, cuts = np.zeros(len(chosen)), np.log((np.arange(1, top + 1)) / (top + 1 - np.arange(1, top + 1) + 1e-9) + 1.0)
    gaps = np.concatenate((cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))))
    m, v = np.zeros(len(w) + len(gaps)), np.zeros(len(w) + len(gaps))
    for step in range(1, steps + 1):
        theta = np.cumsum(np.concatenate((gaps[:1], np.exp(gaps[1:]))))
        s = np.bincount(r, w[c], minlength=n)
        cdf = np.concatenate((np.zeros((n, 1)), 1 / (1 + np.exp(-np.clip(theta[None, :] - s[:, None], -40, 40))), np.ones((n, 1))), axis=1)
        density = cdf * (1 - cdf)
        rows = np.arange(n)
        p = np.maximum(cdf[rows, grade + 1] - cdf[rows, grade], 1e-12)
        by_score = (density[rows, grade + 1] - density[rows, grade]) / p / n  # of -log p
        by_theta = np.zeros(len(theta))
        for k in range(top):
            by_theta[k] = (-(density[:, k + 1] / p)[grade == k].sum() + (density[:, k + 1] / p)[grade == k + 1].sum()) / n
        by_gap = np.cumsum(by_theta[::-1])[::-1]
        by_gap[1:] *= np.exp(gaps[1:])
        g = np.concatenate((np.bincount(c, by_score[r], minlength=len(w)) + decay * w, by_gap))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[: len(w)]
        gaps -= move[len(w) :]
    weights[chosen] = w
    model = Model(weights, np.cumsum(np.concatenate((gaps[:1], np.exp(gaps[1:])))))
    p = 1 - model.grades(np.bincount(r, w[c], minlength=n))[:, 0]
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(high[order])
    f1 = 2 * hits / (np.arange(1, n + 1) + high.sum())
    ends = np.append(p[order][1:] < p[order][:-1], True)  # a cut is between different values only
    best = int(np.argmax(np.where(ends, f1, 0)))
    model.toxic_from = float((p[order][best] + p[order][min(best + 1, n - 1)]) / 2)
    return model


def sampled(labels: DataFrame, max_per_grade: int) -> DataFrame:
    """_id, grade of the labels with the smallest id hashes, max_per_grade of each grade at most.

    A cut of the hashes that leaves twice as many as asked comes first, so
    that no grade is ranked whole in one task.
    """
    hashed = labels.withColumn("_hash", F.shiftrightunsigned(F.xxhash64("_id"), 1))
    cuts = labels.groupBy("grade").agg((F.lit(2.0**63) * F.least(F.lit(1.0), F.lit(2.0 * max_per_grade + 100) / F.count(F.lit(1)))).alias("_cut"))
    near = hashed.join(F.broadcast(cuts), "grade").where("_hash <= _cut")  # top_grade + 1 rows at most
    place = F.row_number().over(Window.partitionBy("grade").orderBy("_hash", "_id"))
    return near.withColumn("_n", place).where(F.col("_n") <= max_per_grade).select("_id", "grade")


def train(docs: DataFrame, graded: DataFrame, doc_id: str = "doc_id", text: str = "text", max_per_grade: int = 3000, most_features: int = 4096, top_grade: int = 9) -> Model:
    """graded: doc_id, grade. Only numbers of selected features of the bounded sample reach the driver."""
    stage = Stage(docs.sparkSession)
    labels = graded.select(F.col("doc_id").alias("_id"), F.least(F.col("grade").cast("int"), F.lit(top_grade)).alias("grade")).where("grade >= 0 and _id is not null")
    first = stage.put(sampled(labels, max_per_grade))
    rows = docs.select(docs[doc_id].alias("_id"), docs[text].alias("_text")).join(stage.small(first), "_id").select("grade", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_text", PIECE_BYTES):
                row, number = features(piece.column(1))
                pairs = np.unique(row << BITS | number)
                ends = np.searchsorted(pairs >> BITS, np.arange(piece.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([piece.column(0), lists], ["grade", "numbers"])

    found = stage.put(rows.mapInArrow(run, "grade int, numbers array<int>"))
    n, high = found.agg(F.count(F.lit(1)), F.sum((F.col("grade") > 0).cast("long"))).first()
    if not n or not high or high == n:
        return Model(np.zeros(1 << BITS), np.array([-50.0 if n and high == n else 50.0]))
    share = high / n
    seen = found.select((F.col("grade") > 0).cast("long").alias("high"), F.explode("numbers").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("seen"), F.sum("high").alias("seen_high")).where("seen >= 4")
    z = (F.col("seen_high") - F.col("seen") * share) / F.sqrt(F.col("seen") * (share * (1 - share)))
    # marks of a grade above 0 only: long clean texts gather nothing
    chosen = seen.select("number", z.alias("z")).where("z > 6.5").orderBy(F.desc("z"), "number").limit(most_features)
    numbers = sorted(r["number"] for r in chosen.collect())
    wanted = F.array(*[F.lit(x) for x in numbers]).cast("array<int>")
    sample = found.select("grade", F.array_intersect("numbers", wanted).alias("numbers")).toArrow()
    lists = pa.concat_arrays([c for c in sample.column("numbers").chunks]) if sample.num_rows else pa.array([], type=pa.list_(pa.int32()))
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    grade = np.concatenate([np.asarray(c) for c in sample.column("grade").chunks]).astype(np.int64)
    return fit(np.repeat(np.arange(len(sizes)), sizes), np.asarray(lists.flatten()).astype(np.int64), grade, np.array(numbers, dtype=np.int64))


def toxicity(docs: DataFrame, graded: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), max_per_grade: int = 3000) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic (P(grade > 0)), grade (likeliest), toxic and the keep columns, a row for each row of docs.

    toxic: p_toxic at or above the cut of best F1 in the fitted sample.
    """
    model = train(docs, graded, doc_id, text, max_per_grade)
    n = len(keep)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("_text"), *[docs[c].alias(f"k_{i}") for i, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_text", PIECE_BYTES):
                p = model.grades(model.scores(piece.column(1)))
                severity = np.round((p * np.arange(p.shape[1])).sum(axis=1), 6)
                high = np.round(1 - p[:, 0], 6)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(severity), pa.array(high), pa.array(p.argmax(axis=1)), pa.array(high >= model.toxic_from), *(piece.column(2 + i) for i in range(n))], ["doc_id", "severity", "p_toxic", "grade", "toxic", *(f"k_{i}" for i in range(n))])

    kept_types = "".join(f", k_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = rows.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, severity double, p_toxic double, grade long, toxic boolean{kept_types}")
    results = ["doc_id", "severity", "p_toxic", "grade", "toxic"]
    return out.select(*results, *[F.col(f"k_{i}").alias(name) for i, (_, name) in enumerate(carried(keep, results))])
