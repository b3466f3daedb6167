"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.secrets import KINDS, joined, secret_scan

    found = secret_scan(table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    live = lambda yes: F.size(F.filter("all_spans", lambda x: x["live"] == F.lit(yes))).cast("long")
    counts = [of_kind(i).alias(f"n_{name}") for i, (name, *_) in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"), live(True).alias("n_live"), live(False).alias("n_copied"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.decontaminate import containment_matches

    found = containment_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", "containment")


OP2_SQL = r"""
with d as (select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
     i as (select item_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from benchmark),
     ds as (select distinct id, array_to_string(w[k:k + 4], ' ') as s from (select id, w, unnest(range(1, len(w) - 3)) as k from d where len(w) >= 5)),
     its as (select distinct id, array_to_string(w[k:k + 4], ' ') as s from (select id, w, unnest(range(1, len(w) - 3)) as k from i where len(w) >= 5)),
     n as (select id, count(*) as n_item from its group by id),
     p as (select ds.id as doc_id, its.id as item_id, count(*) as n_shared from ds join its using (s) group by all)
select doc_id, item_id, n_item, n_shared, round(n_shared / n_item, 6) as containment
from p join n on n.id = p.item_id where 100 * n_shared >= 80 * n_item
"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.quality import quality_rules

    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.line_dedup import fuzzy_line_dedup

    found = fuzzy_line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from foliant.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ the parts of the results that SQL can express
# each goes through its operator, as the query above does


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op1_secret_scan."""
    return op1_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def _secret_sql() -> str:
    from foliant.llm.secrets import KINDS

    kinds = " union all ".join(f"""select doc_id, text, {i} as no, '{name}' as kind, regexp_extract_all(text, '{p.replace("'", "''")}', 0) as m, regexp_extract_all(text, '{p.replace("'", "''")}', {g}) as v, string_split_regex(text, '{p.replace("'", "''")}') as g, {n} as least from t""" for i, (name, p, g, n) in enumerate(KINDS))
    return f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
     k as ({kinds}),
     p as (select doc_id, no, kind, least, m, v, g, unnest(range(1, len(m) + 1)) as i from k),
     s as (select doc_id, no, kind, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as a, length(m[i]) as n from p where length(v[i]) >= least),
     j as (select doc_id, count(*) filter (no = 0) as n0, count(*) filter (no = 1) as n1, count(*) filter (no = 2) as n2, string_agg(kind || ':' || cast(a as bigint) || ':' || cast(a + n as bigint), ',' order by a, no) as spans from s group by doc_id)
select doc_id, coalesce(n0, 0) as n_assign, coalesce(n1, 0) as n_access, coalesce(n2, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256 from t left join j using (doc_id)
"""


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of op6_quality_rules but the length of the longest repeat."""
    return op6_quality_rules(spark, sf_dir).drop("longest_repeat")


QUALITY_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
     d as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
     p as (select doc_id, k, array_to_string(w[k:k + 4], ' ') as five from (select doc_id, w, unnest(range(1, len(w) - 3)) as k from d where len(w) >= 5)),
     r as (select doc_id, unnest(range(k, k + 5)) as place from (select doc_id, k, count(*) over (partition by doc_id, five) as n from p) where n > 1),
     n as (select doc_id, count(distinct place) as n_repeat_words from r group by doc_id),
     l as (select distinct doc_id from (select doc_id, array_to_string(w[k:k + 400], ' ') as long from (select doc_id, w, unnest(range(1, len(w) - 399)) as k from d where len(w) > 400)) group by doc_id, long having count(*) > 1),
     c as (select doc_id, len(w) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, l.doc_id is not null as long_repeat
           from d left join n using (doc_id) left join l using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or long_repeat) as kept from c
"""


def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of op9_token_counts."""
    return op9_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of op10_mixing."""
    return op10_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


MIX_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
     s as (select source, sum(size) as source_size, cast([3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as double) as weight from d group by source),
     h as (select *, coalesce(sum(2 * source_size) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as held,
                  sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as free, 1.5 * sum(source_size) over () as total from s),
     v as (select *, max(case when (total - held) / free * weight <= 2 * source_size then (total - held) / free end) over () as level from h)
select doc_id, size, cast(source_size as bigint) as source_size, round(least(2.0 * source_size, coalesce(level * weight, 2.0 * source_size)), 3) as target
from d join v on d.source is not distinct from v.source
"""

NEAR_SQL = r"""
with recursive d as (select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
     s as (select distinct id, array_to_string(w[k:k + 3], ' ') as x from (select id, w, unnest(range(1, greatest(len(w) - 2, 2))) as k from d where len(w) > 0)),
     n as (select id, count(*) as n from s group by id),
     p as (select a.id as a, b.id as b, count(*) as shared from s as a join s as b on a.x = b.x and a.id <> b.id group by a.id, b.id),
     l as (select a, b from p join n as x on x.id = a join n as y on y.id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
     c as (select id, id as least from d union select c.id, l.b as least from c join l on l.a = c.least),
     m as (select id, min(least) as least from c group by id)
select d.id as doc_id, coalesce(n.n, 0) as n_shingles, m.least as component_id, d.id = m.least as kept from d left join n using (id) join m using (id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_decontaminate, op3_url_filter, op4_suffix_dedup, op5_near_duplicates, op6_quality_rules, op7_toxicity, op8_line_dedup, op9_token_counts, op10_mixing, secret_base, quality_base, token_bytes, mix_targets)
}

ORACLES: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op5_near_duplicates": NEAR_SQL,
    "secret_base": _secret_sql(),
    "quality_base": QUALITY_SQL,
    "token_bytes": "select doc_id, strlen(coalesce(text, '')) as n_bytes from documents",
    "mix_targets": MIX_SQL,
}
