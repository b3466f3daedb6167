"""The registered queries on the smallest tables: against their SQL where they have one, else against brute force."""

import hashlib
import os

import pytest

from tests.llm.test_operators import WORD, filled, removed_brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def names():
    from foliant.llm.queries import ORACLES

    return sorted(ORACLES)


@pytest.mark.parametrize("name", names())
def test_sql(spark, duck, name):
    from foliant.llm.queries import ORACLES, QUERIES

    df, sql = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    columns = sorted(df.columns) if name != "op2_decontaminate" else sorted(sql.columns)
    assert columns == sorted(sql.columns)
    at = [sql.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in sql.fetchall())


def test_suffix_query(spark, documents):
    from foliant.llm.queries import QUERIES

    got = {r["doc_id"]: r for r in QUERIES["op4_suffix_dedup"](spark, SF).collect()}
    for r, want in zip(documents, removed_brute([(r["text"] or "").encode() for r in documents], 200), strict=True):
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) == want


def test_line_query(spark):
    """Its digest is of the texts that the operator gives."""
    from foliant.llm.line_dedup import fuzzy_line_dedup
    from foliant.llm.queries import QUERIES

    got = {r["doc_id"]: r["kept_sha256"] for r in QUERIES["op8_line_dedup"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in fuzzy_line_dedup(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items()}


def test_token_query(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    from foliant.llm.queries import QUERIES

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r["doc_id"]: len(plain.encode(r["text"] or "", add_special_tokens=False).ids) for r in documents}
    assert {r["doc_id"]: r["n_tokens"] for r in QUERIES["op9_token_counts"](spark, SF).collect()} == want


def taken_brute(rows, block, weights_filled):
    """The words that a golden-ratio schedule takes, from the streams in the order that the plan gives. rows: (source, place, id, size)."""
    from math import floor

    from foliant.llm.mixing import GOLDEN_62

    names = sorted({r[0] for r in rows}, key=lambda s: (s is None, s or ""))
    total, upto, shares = sum(weights_filled.values()), 0.0, []
    for s in names:
        shares.append((upto / total, (upto + weights_filled[s]) / total, s))
        upto += weights_filled[s]
    n, ranks, taken = round(total / block), dict.fromkeys(names, 0), {r[2]: 0 for r in rows}
    streams = {s: [(r[2], k) for _ in range(2) for r in sorted((x for x in rows if x[0] == s), key=lambda x: x[1]) for k in range(r[3])] for s in names}
    for t in range(n):
        point = ((t + 1) * GOLDEN_62 % 2**62) / 2**62
        s = next((name for a, b, name in shares if a <= point < b), names[-1])
        k = ranks[s]
        ranks[s] += 1
        for i, _ in streams[s][floor(k * block) : (k + 1) * block]:
            taken[i] += 1
    return taken


def test_taken(spark, documents):
    """op10's taken words: the schedule worked out slot by slot."""
    from pyspark.sql import functions as F

    from foliant.llm.mixing import mix

    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in documents[:60]] + [(1000, None, None), (1001, "a b c", None)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mix(docs, block_words=16).collect()}
    ident = F.xxhash64("source", "doc_id", "text")
    order = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit("order"), ident, F.lit(0).cast("long")), 1).alias("h"), ident.alias("i")).collect()}
    raw = {r["doc_id"]: (r["p"], r["h"]) for r in docs.select("doc_id", F.xxhash64(F.lit("order"), ident, F.lit(0).cast("long")).alias("h")).withColumn("p", F.pmod(F.shiftrightunsigned("h", 1), F.lit(16))).collect()}
    assert len(order) == len(raw)
    rows = [(r["source"], raw[r["doc_id"]], r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in docs.collect()]
    sizes = {}
    for s, _, _, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    assert {i: r["taken"] for i, r in got.items()} == taken_brute(rows, 16, filled(sizes, 150, 2))


def test_url_features(spark):
    """The lexical features of a few urls by hand."""
    import math
    from collections import Counter

    from foliant.llm.url_filter import host_of, lexical, path_of
    from pyspark.sql import functions as F

    urls = ["http://a-b.example.com/x/y.html?q=1&r=22#z", "https://é.net", "", None, "ftp://x.org/1/2/3/", "no url 12"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    for r in lexical(df).collect():
        u = r["url"] or ""
        counts = Counter(u)
        assert r["f_length"] == len(u) and r["f_digits"] == pytest.approx(sum(c in "0123456789" for c in u) / len(u) if u else 0)
        assert r["f_entropy"] == pytest.approx(-sum(k / len(u) * math.log2(k / len(u)) for k in counts.values()) if u else 0)
    one = next(r for r in lexical(df).collect() if r["url"] == urls[0])
    assert (one["f_depth"], one["f_params"], one["f_labels"], one["f_hyphens"], one["f_fragment"], one["suffix"], one["extension"]) == (2, 2, 2, 1, 1, "com", "html")


def test_ordinal_gradient():
    """The fitted likelihood is at a stationary point: moving any weight or threshold does not raise it."""
    import numpy as np

    from foliant.llm.toxicity import BITS, fit

    rng = np.random.RandomState(0)
    n = 400
    x = rng.rand(n, 3) < 0.4
    score = x @ np.array([1.5, 0.7, 2.5]) + rng.logistic(size=n)
    grade = (score > 1.5).astype(int) + (score > 3.2)
    row, col = np.nonzero(x)
    model = fit(row, col + 5, grade, np.array([5, 6, 7]), decay=0.0, steps=3000, rate=0.02)

    def likelihood(w, cuts):
        upto = 1 / (1 + np.exp(-(np.asarray(cuts)[None, :] - (x @ w)[:, None])))
        p = np.diff(np.concatenate((np.zeros((n, 1)), upto, np.ones((n, 1))), axis=1), axis=1)
        return np.log(p[np.arange(n), grade]).mean()

    w, cuts = model.weights[[5, 6, 7]], model.thresholds
    assert len(model.weights) == 1 << BITS and (np.diff(cuts) > 0).all()
    best = likelihood(w, cuts)
    for k in range(3):
        for step in (-0.05, 0.05):
            assert likelihood(w + step * np.eye(3)[k], cuts) < best
    for k in range(2):
        for step in (-0.05, 0.05):
            assert likelihood(w, cuts + step * np.eye(2)[k]) < best
    assert w[0] > 0.8 and w[2] > w[0] > w[1]


def test_url_heldout(spark):
    """Trees fitted on four fifths of the urls that rules decide, on the last fifth; no rule is used to judge."""
    from pyspark.sql import functions as F

    from foliant.llm.url_filter import RULES, host_of, path_of, rule_of, url_filter

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    rule = rule_of(host_of(F.col("url")), path_of(F.col("url")), RULES)
    known = pages.withColumn("r", rule).where("r is not null").select("page_id", "url", (F.col("r.verdict") == "block").cast("int").alias("label")).cache()
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    got = url_filter(known.where(held), known.where(~held).select("url", "label"), keep=("label",), rules=()).select("label", "verdict").collect()
    right = sum((r["verdict"] == "block") == bool(r["label"]) for r in got)
    print(f"held out: {right} of {len(got)}; blocked {sum(r['label'] for r in got)}")
    assert len(got) > 15 and right >= 0.8 * len(got)
