"""Secret scan with corpus-wide ownership frequency.

Candidates are regular-expression matches in whole texts. The hash of every
candidate's value is counted over distinct repositories and distinct owners of
the whole corpus: values of more than ``max_owners`` owners are copied
examples, the others are live-looking. Spans of the base kinds always stay;
spans of the wide kinds (random-looking strings) are added where they are
live-looking.

Matches are located without Python: the pieces between the matches of a text
give their offsets. The text is scanned once; only spans and value hashes go
on. Offsets are running sums over the matches of a row and kind, and a wide
span is dropped where a base span overlaps it, both by windows over the row's
matches, so the work grows with the number of matches (and a sort of them).
Frequencies are counted per (value, owner, repository), then per (value,
owner), then per value, each combined before its shuffle, so that a value that
a third of all rows hold is no hot group; the counts are written before they
are joined back, so that such a value is split.

Defined results: null and empty texts have no spans; offsets are code points,
end exclusive; null owners and repositories count as one each; repeated rows
are scanned row by row and count once as the same repository; of spans that
start together the earlier kind comes first; very long texts are scanned
whole; an empty table gives an empty table; extra columns are not read unless
named in ``keep`` (``carried`` names those that clash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm._common import Stage, carried

#: Kinds, patterns, the group that holds the value, its least length.
KEYWORDS = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
KINDS = (
    ("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    ("hex", r"([0-9a-f]{16,})", 1, 16),  # the same matches as a run of any length, filtered
)
WIDE_KINDS = (("random", r"([A-Za-z0-9_-]{24,})", 1, 24),)
MATCH = "array<struct<kind:int,n:int,gap:int,size:int,value:string>>"
SPAN = "array<struct<start:int,kind:int,end:int,live:boolean,n_repos:bigint,n_owners:bigint>>"


def matches(text: Column, pattern: str, group: int, kind: int) -> Column:
    """The leftmost non-overlapping matches in order: characters since the one before, their own, and the value."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    found = F.transform(rows, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("n"), F.length(x["gap"]).alias("gap"), F.length(x["all"]).alias("size"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), found.cast(MATCH)).otherwise(F.array().cast(MATCH))


def located(rows: DataFrame) -> DataFrame:
    """row, repo, owner, start, kind, end, value_hash: the spans of rows' matches, failing ones and overlapped wide ones dropped."""
    each = rows.where(F.size("matches") > 0).select("row", "repo", "owner", F.explode("matches").alias("m")).select("row", "repo", "owner", "m.*")
    upto = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = each.withColumn("end", upto.cast("int")).withColumn("start", F.col("end") - F.col("size"))
    kinds = (*KINDS, *WIDE_KINDS)
    base = F.col("kind") < len(KINDS)
    passed = F.length("value") >= F.element_at(F.array(*[F.lit(k[3]) for k in kinds]), F.col("kind") + 1)
    each = each.where(passed & (base | random_looking(F.col("value")))).select("row", "repo", "owner", "start", "kind", "end", F.md5("value").alias("value_hash"))
    # both frames only grow (one that shrinks would be computed again for each row)
    ahead, back = Window.partitionBy("row").orderBy("start", "kind"), Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"))
    ended = F.max(F.when(base, F.col("end"))).over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    begun = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumns({"ended": ended, "begun": begun})
    return each.where(base | ((F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("begun") >= F.col("end"), F.lit(True))))).drop("ended", "begun")


def random_looking(value: Column) -> Column:
    return value.rlike("[0-9].*[0-9].*[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in (*KINDS, *WIDE_KINDS)])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def ownership(spans: DataFrame) -> DataFrame:
    """value_hash, n_repos, n_owners from value_hash, repo, owner."""
    per_repo = spans.groupBy("value_hash", "owner", "repo").agg(F.lit(1).alias("one"))
    per_owner = per_repo.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("value_hash").agg(F.sum("n").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def secret_scan(docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source", keep: tuple[str, ...] = ("doc_id",), max_owners: int = 2, most_random_owners: int = 1) -> DataFrame:
    """keep columns, base_spans, all_spans (arrays of start, kind, end, live) and counts, a row for each row of docs."""
    stage = Stage(docs.sparkSession)
    body = F.coalesce(docs[text], F.lit(""))
    every = F.concat(*[matches(body, p, g, i) for i, (_, p, g, _) in enumerate((*KINDS, *WIDE_KINDS))])
    rows = stage.put(docs.select(docs[repo].cast("string").alias("repo"), docs[owner].cast("string").alias("owner"), every.alias("matches"), F.monotonically_increasing_id().alias("row"), *[docs[c].alias(f"k_{i}") for i, c in enumerate(keep)]))
    spans = stage.put(located(rows))
    known = spans.join(stage.put(ownership(spans.select("value_hash", "owner", "repo"))), "value_hash")
    live = F.when(F.col("kind") < len(KINDS), F.col("n_owners") <= max_owners).otherwise(F.col("n_owners") <= most_random_owners)
    known = known.select("row", "kind", F.struct("start", "kind", "end", live.alias("live"), "n_repos", "n_owners").alias("span")).where((F.col("kind") < len(KINDS)) | F.col("span.live"))
    per_row = known.groupBy("row").agg(F.array_sort(F.collect_list("span")).cast(SPAN).alias("all_spans"))
    out = rows.select("row", *[f"k_{i}" for i in range(len(keep))]).join(per_row, "row", "left").withColumn("all_spans", F.coalesce("all_spans", F.array().cast(SPAN)))
    out = out.withColumn("base_spans", F.filter("all_spans", lambda x: x["kind"] < len(KINDS)))
    return out.select(*[F.col(f"k_{i}").alias(name) for i, (_, name) in enumerate(carried(keep, ("base_spans", "all_spans")))], "base_spans", "all_spans")
