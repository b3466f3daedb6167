"""URL filter: host and path rules, else gradient-boosted trees on lexical features.

The trees (log-loss boosting, Spark ML) see only the url: lengths, depth,
digit ratio, character entropy, counts of parameters, dots and hyphens, and
the smoothed share of blocked urls of the host's suffix and of the file
extension in the labelled data. They are fitted on at most ``max_labelled``
labelled urls, the ones with the smallest hashes; that bound is a parameter.

Defined results: null urls and urls without "://" have an empty host and path,
match no rule, and get the trees' verdict on an empty url; of rules that fit
equally long the later in the order of (verdict, host, path) wins; repeated
rows are judged alike; very long urls are read whole; with no labelled urls, or
of one class only, the verdict is that class's (allow if none); an empty table
gives an empty table; extra columns are not read unless named in ``keep``
(``carried`` names those that clash).
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm._common import Stage, carried, lower_ascii

#: Verdict, host, path of each rule.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
FEATURES = ("f_length", "f_host", "f_path", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_hyphens", "f_fragment", "f_suffix", "f_extension")
BLOCKED_FROM = 0.5


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest fitting rule as a struct of name and verdict, else null. Longest: host and path together."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own_host, own_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        found = F.when(fits, F.struct(F.lit(own_host + own_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def entropy(s: Column) -> Column:
    """Bits per character."""
    n = F.length(s).cast("double")
    chars = F.split(s, "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.when(F.length(c) == 1, F.length(s) - F.length(F.replace(s, c, F.lit("")))).otherwise(F.lit(0)).cast("double"))
    return F.aggregate(counts, F.lit(0.0), lambda a, k: a - F.when((k > 0) & (n > 0), k / n * F.log2(k / n)).otherwise(0.0))


def lexical(df: DataFrame) -> DataFrame:
    """df (url, host, path) with the plain features and the keys of the suffix statistics."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    count = lambda s, p: F.coalesce(F.regexp_count(s, F.lit(p)), F.lit(0)).cast("double")
    return df.withColumns(
        {
            "f_length": F.length(url).cast("double"), "f_host": F.length(host).cast("double"), "f_path": F.length(path).cast("double"), "f_depth": count(path, "/[^/]"),
            "f_digits": _share(count(url, "[0-9]"), F.length(url)), "f_entropy": entropy(url), "f_params": count(url, "[?&][^=&#]+="), "f_labels": count(host, "[.]"), "f_hyphens": count(host, "-"), "f_fragment": count(url, "#"),
            "suffix": F.substring_index(host, ".", -1), "extension": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1),
        }
    )


def rates(labelled: DataFrame, key: str, weight: float = 10.0) -> DataFrame:
    """key, f_<key>: the share of blocked urls, drawn to the overall one half by weight."""
    return labelled.groupBy(key).agg(((F.sum("label") + weight / 2) / (F.count(F.lit(1)) + weight)).alias(f"f_{key}"))


def url_filter(pages: DataFrame, labelled: DataFrame | None = None, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules: tuple[tuple[str, str, str], ...] = RULES, max_labelled: int = 20_000, trees: int = 10, depth: int = 4) -> DataFrame:
    """keep columns, host, path, rule, verdict, score: one row for each row of pages.

    labelled: url, label (1 block, 0 allow). If none is given, the urls that a
    rule decides are the labelled ones.
    """
    stage = Stage(pages.sparkSession)
    judged = pages.select(*[pages[c].alias(f"k_{i}") for i, c in enumerate(keep)], pages[url].alias("url"))
    judged = judged.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    judged = judged.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = judged.where("_rule is not null").select("url", "host", "path", (F.col("_rule.verdict") == "block").cast("double").alias("label"))
    else:
        labelled = labelled.select("url", F.col("label").cast("double").alias("label")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    sample = stage.put(lexical(labelled.distinct().orderBy(F.xxhash64("url"), "url", "label").limit(max_labelled)))
    blocked, n = sample.agg(F.sum("label"), F.count(F.lit(1))).first()
    out = lexical(judged)
    if n and 0 < blocked < n:
        assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        by = {key: stage.put(rates(sample, key)) for key in ("suffix", "extension")}

        def known(df: DataFrame) -> DataFrame:
            for key, table in by.items():  # at most max_labelled rows each
                df = df.join(F.broadcast(table), key, "left").fillna(0.5, [f"f_{key}"])
            return assemble.transform(df)

        model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=7, maxMemoryInMB=64, cacheNodeIds=False).fit(known(sample).select("features", "label").coalesce(4))
        out = model.transform(known(out)).withColumn("score", vector_to_array("probability")[1])
    else:
        out = out.withColumn("score", F.lit(1.0 if n and blocked == n else 0.0))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= BLOCKED_FROM, "block").otherwise("allow"))
    names = [name for _, name in carried(keep, ("host", "path", "rule", "verdict", "score"))]
    return out.select(*[F.col(f"k_{i}").alias(name) for i, name in enumerate(names)], "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.round("score", 6).alias("score"))
