"""The corpus pipeline: five stages, each an operator of foliant.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of docs, in their order. Stages work on whatever
columns docs has besides doc_id and text, whatever their names: an operator
sees docs with its columns renamed, so no name can clash with its own.

Defined results of every stage: an empty table gives an empty table; null ids
are ids, and rows that share an id but not a text are different documents;
null and blank texts are rejected by the quality rules, and pass unchanged
through any later stage but the mix, which takes no words of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._common import SPACES, Stage, carried, table
from foliant.llm.decontaminate import containment_matches
from foliant.llm.line_dedup import fuzzy_line_dedup
from foliant.llm.minhash_dedup import without_near_duplicates
from foliant.llm.mixing import mix
from foliant.llm.quality import quality_rules


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c_0, c_1 and so on, and the new name of each old one."""
    names = [f"c_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def _named(df: DataFrame, names: dict[str, str], **instead: Column) -> DataFrame:
    """The columns of the documents under their old names; instead: what takes the place of one."""
    return df.select(*[instead.get(old, F.col(new)).alias(old) for old, new in names.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; equal rows are judged alike."""
    own, names = _renamed(docs)
    return _named(quality_rules(own, names["text"], keep=tuple(own.columns)).where("kept"), names)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier one go, and documents of which no word is left.

    Rows equal in id and text keep the same lines. n_chars, if it is there as
    a number, follows the text.
    """
    own, names = _renamed(docs)
    out = fuzzy_line_dedup(own, names["doc_id"], names["text"], keep=tuple(c for c in own.columns if c not in (names["doc_id"], names["text"])))
    out = out.where((F.col("n_removed") == 0) | (F.btrim("text", F.lit(SPACES)) != ""))
    instead = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in names and docs.schema["n_chars"].dataType.simpleString() in ("int", "bigint"):
        instead["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(names["n_chars"])).cast(docs.schema["n_chars"].dataType)
    return _named(out, names, **instead)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, the one of least id: five-word shingles, similarity 0.8.

    Of rows equal in id and text, too, one stays.
    """
    own, names = _renamed(docs)
    return _named(without_near_duplicates(own, names["doc_id"], names["text"], width=5), names)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; other texts of the same id stay."""
    own, names = _renamed(docs)
    found = containment_matches(own, table(spark, sf_dir, "benchmark"), names["doc_id"], names["text"]).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return _named(own.join(found, own[names["doc_id"]].eqNullSafe(found["_id"]) & (F.xxhash64(own[names["text"]]) == found["_hash"]), "left_anti"), names)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target and taken.

    Columns of docs with these names get the ending _in.
    """
    own, names = _renamed(docs)
    out = mix(own, names["doc_id"], names["source"], names["text"], keep=tuple(own.columns)).where("taken > 0")
    results = ("size", "source_size", "target", "taken")
    return out.select(*[F.col(names[c]).alias(name) for c, name in carried(docs.columns, results)], *results)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontaminate", benchmark_stage), ("mix_sources", mix_stage)]

#: Near-duplicate stages and the mix's schedule have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage, docs = Stage(spark), table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage.put(docs)
    return docs
