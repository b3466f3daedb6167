"""Null ids, repeated rows, ids used twice, clashing names and empty tables through every operator."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import WORD, prose, removed_brute

CLASHING = ("kept", "KEPT", "n_words", "size", "target", "taken", "severity", "toxic", "score", "host", "rule", "verdict", "row", "h", "id", "_text", "k_0", "w", "n_tokens", "spans", "all_spans", "n_removed", "n_lines", "component_id", "first", "text_hash", "n_bytes")


def texts():
    rng = random.Random(31)
    a, b = prose(rng, 90), prose(rng, 90)
    return [(None, a), (None, a), (None, b), (3, a), (3, b), (4, None), (4, ""), (5, " \n\t"), (6, a + "\n" + a), (6, a + "\n" + a), (7, "one"), (8, "x" * 5000), (9, prose(rng, 4000))]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, None if n % 4 == 0 else f"s{n % 3}") for n, (i, t) in enumerate(texts())], "doc_id long, text string, source string")
    spark.conf.set("spark.sql.caseSensitive", "true")
    df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHING if c != "KEPT"})
    spark.conf.set("spark.sql.caseSensitive", "false")
    return df.repartition(3).cache()


def pairs(df, *columns):
    return Counter((r["doc_id"], *(r[c] for c in columns)) for r in df.collect())


def test_secrets(spark, docs):
    from foliant.llm.secrets import secret_scan

    key = "password=abcdefghijklmnop Zx9Kq2Lm8Vb4Nc7Tr1Yp5Ws3"
    df = docs.select(*[c for c in docs.columns if c != "text"], F.when(F.col("text").isNotNull(), F.concat("text", F.lit(" " + key))).alias("text"))
    got = secret_scan(df, keep=("doc_id", "all_spans", "row")).collect()
    assert len(got) == len(texts()) and all(r["all_spans_in"] == "own all_spans" and r["row"] == "own row" for r in got)
    assert sum(len(r["base_spans"]) for r in got) == sum(t is not None for _, t in texts())


def test_decontaminate(spark, docs):
    from foliant.llm.decontaminate import containment_matches

    item = texts()[0][1]
    items = spark.createDataFrame([(None, item), (2, item), (2, item + " more"), (3, None)], "item_id long, text string")
    got = containment_matches(docs, items).select("doc_id", "item_id", "text_hash").collect()
    found = Counter((r["doc_id"], r["item_id"]) for r in got)
    # repeated rows count once; both items of id 2 match
    assert found == {(d, i): n for d in (None, 3, 6) for i, n in ((None, 1), (2, 2))}


def test_urls(spark):
    from foliant.llm.url_filter import url_filter

    urls = [(None, None), (1, "http://a.com/en/x"), (1, "http://a.com/en/x"), (None, "http://b.net/de/"), (2, "http://" + "a" * 20000 + ".org/es/")]
    df = spark.createDataFrame([(*u, "own host") for u in urls], "page_id long, url string, host string")
    got = url_filter(df, keep=("page_id", "host")).collect()
    assert len(got) == 5 and all(r["host_in"] == "own host" for r in got)
    assert Counter((r["page_id"], r["rule"], r["verdict"]) for r in got if r["rule"]) == {(1, "com/en/", "block"): 2, (None, "net/de/", "allow"): 1, (2, "org/es/", "block"): 1}


def test_suffixes(docs):
    from foliant.llm.suffix_dedup import suffix_dedup

    got = suffix_dedup(docs, keep=("kept", "n_bytes", "row"), body=True)
    want = Counter((i, *x) for (i, _), x in zip(texts(), removed_brute([(t or "").encode() for _, t in texts()], 200), strict=True))
    assert pairs(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert all(r["kept_in"] == "own kept" and len(r["kept"]) == r["n_bytes"] - r["n_removed"] and r["row"] == "own row" for r in got.collect())


def test_near(docs):
    from foliant.llm.minhash_dedup import near_duplicates

    got = near_duplicates(docs, keep=("kept", "first", "text"), single=True).collect()
    assert len(got) == len(texts()) and all(r["kept_in"] == "own kept" and r["first_in"] == "own first" for r in got)
    a, b = texts()[0][1], texts()[2][1]
    assert {r["component_id"] for r in got if r["text"] == a} == {3} and {r["component_id"] for r in got if r["text"] == b} == {3}
    # one row of each of the five sets of similar texts, and the three rows without words
    assert sum(r["first"] for r in got if r["text"] == a) == 1 and sum(r["first"] for r in got) == 5 + 3


def test_quality(docs):
    from foliant.llm.quality import quality_rules

    got = quality_rules(docs, keep=("doc_id", "kept", "n_words")).collect()
    assert Counter((r["doc_id"], r["n_words"]) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t in texts())
    assert all(r["kept_in"] == "own kept" and r["n_words_in"] == "own n_words" for r in got)


def test_quality_of_long_repetitive_text(spark):
    """A million equal words: ranks are kept for the levels that the rules ask for only."""
    from foliant.llm.quality import quality_rules

    got = quality_rules(spark.createDataFrame([(1, "same " * 1_000_000)], "doc_id long, text string")).first()
    assert (got["n_words"], got["n_repeat_words"], got["longest_repeat"], got["kept"]) == (1_000_000, 1_000_000, 401, False)


def test_toxicity(spark, docs):
    from foliant.llm.toxicity import toxicity

    labels = spark.createDataFrame([(3, 1), (6, 0), (None, 2), (4, None), (7, -1), (9, 99), (9, 0)], "doc_id long, grade int")
    got = toxicity(docs, labels, keep=("toxic", "severity")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in texts()) and all(r["toxic_in"] == "own toxic" and 0 <= r["severity"] <= 9 for r in got)
    assert {r["severity"] for r in toxicity(docs, labels.where("grade = 0")).collect()} == {0.0}
    assert {r["severity"] for r in toxicity(docs, labels.where("grade > 0")).collect()} == {1.0}


def test_toxicity_sample(spark):
    """The sample holds the labels of the least hashes of each grade, however unequal the grades are."""
    from foliant.llm.toxicity import sampled

    labels = spark.createDataFrame([(i, 0 if i % 50 else 1) for i in range(5000)] + [(17, 0), (17, 0)], "_id long, grade int")
    got = Counter(r["grade"] for r in sampled(labels, 60).collect())
    assert got == {0: 60, 1: 60}
    best = labels.where("grade = 0").withColumn("h", F.shiftrightunsigned(F.xxhash64("_id"), 1)).orderBy("h", "_id").limit(60)
    assert Counter(r["_id"] for r in sampled(labels, 60).where("grade = 0").collect()) == Counter(r["_id"] for r in best.collect())


def test_lines(docs):
    from foliant.llm.line_dedup import fuzzy_line_dedup

    got = fuzzy_line_dedup(docs, keep=("text", "n_lines", "kept")).collect()
    assert len(got) == len(texts()) and all(r["n_lines_in"] == "own n_lines" and r["kept"] == "own kept" for r in got)
    a, b = texts()[0][1], texts()[2][1]
    left = Counter((r["doc_id"], r["text_in"], r["text"]) for r in got)
    # nulls order first among ids: both rows of the first document keep its line
    assert left[(None, a, a)] == 2 and left[(None, b, b)] == 1 and left[(3, a, "")] == 1 and left[(3, b, "")] == 1 and left[(6, a + "\n" + a, "")] == 2
    assert left[(4, None, None)] == 1 and left[(4, "", "")] == 1 and left[(5, " \n\t", " \n\t")] == 1


def test_tokens(docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from foliant.llm.token_counts import token_counts

    got = token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "n_tokens", "n_bytes")).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((i, len((t or "").encode())) for i, t in texts()) and all(r["n_tokens_in"] == "own n_tokens" for r in got)


def test_mix(spark, docs):
    from foliant.llm.mixing import mix

    runs = []
    for n in (2, 7):
        got = mix(docs.repartition(n), keep=("size", "row"), block_words=8).collect()
        assert all(r["size_in"] == "own size" and r["row"] == "own row" and r["taken"] <= 2 * r["size"] for r in got)
        runs.append(Counter((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got))
    # another split of the table gives the same rows: equal rows are told apart by number only
    assert runs[0] == runs[1] and sum(runs[0].values()) == len(texts())


def test_mix_of_many_equal_rows(spark):
    """A third of all rows has a null id and one text."""
    from foliant.llm.mixing import mix

    rng = random.Random(2)
    data = [(None, "a b c d e f g", "s")] * 300 + [(i, prose(rng, 12), f"s{i % 3}") for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    a, b = (Counter((r["doc_id"], r["size"], r["taken"]) for r in mix(df.repartition(n), block_words=16).collect()) for n in (3, 8))
    assert a == b and all(k[2] <= 2 * k[1] for k in a)


def test_empty(spark):
    """Empty tables give empty tables of the same columns."""
    from foliant.llm import decontaminate, line_dedup, minhash_dedup, mixing, quality, secrets, suffix_dedup, toxicity, url_filter

    none = spark.createDataFrame([], "doc_id long, text string, source string, kept int")
    for out in (
        secrets.secret_scan(none), suffix_dedup.suffix_dedup(none, keep=("kept",)), minhash_dedup.near_duplicates(none, keep=("kept",), single=True), quality.quality_rules(none), line_dedup.fuzzy_line_dedup(none, keep=("kept",)), mixing.mix(none, keep=("kept",)),
        toxicity.toxicity(none, spark.createDataFrame([], "doc_id long, grade int")), decontaminate.containment_matches(none, none.withColumnRenamed("doc_id", "item_id")), url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")),
    ):
        assert out.collect() == [] and len(set(out.columns)) == len(out.columns)
