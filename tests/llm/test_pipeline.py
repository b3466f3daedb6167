"""The corpus pipeline on small tables, stage by stage, against brute force."""

import random

from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, WORD, UP, near_brute, prose, rows


def test_stages(spark, tmp_path):
    import corpus_pipeline as c

    rng = random.Random(11)
    item = prose(rng, 30)
    clean = [(400 + i, prose(rng, 150, 100_000), "en", f"s{i % 3}", 0) for i in range(12)]
    leak = [(500, prose(rng, 80, 100_000) + " " + item + " " + prose(rng, 60, 100_000), "en", "s1", 0)]
    near = [(600 + k, " ".join(w + ("q" if i in (5, 60 + k) else "") for i, w in enumerate(clean[0][1].split(" "))), "en", "s2", 0) for k in range(3)]
    spark.createDataFrame([*rows(), *clean, *leak, *near], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, step) in enumerate(c.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        step(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        after_df = spark.read.parquet(str(tmp_path / name))
        if k < len(c.STAGES) - 1:
            assert after_df.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in after_df.collect()}
        seen.append(set(after))
        if name == "quality_rules":
            assert {r[0] for r in clean} <= set(after) and None not in after.values()
        if name == "near_dedup":
            _, component = near_brute(before.items(), 5, 80)
            assert set(after) == {i for i in before if component[i] == i}
        if name == "decontaminate":
            assert 500 in before and 500 not in after and {r[0] for r in clean} <= set(after) and {i for i in before if i not in after} == {500}
        if name == "mix_sources":
            total = sum(len(WORD.findall((t or "").translate(UP))) for t in before.values())
            taken = {r["doc_id"]: r["taken"] for r in after_df.collect()}
            assert abs(sum(taken.values()) - 1.5 * total) <= 400
        docs = after_df
    assert [n for n, _ in c.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "mix_sources"]


def test_run(spark, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = c.run(spark, str(tmp_path))
    assert out.count() > 10 and {"doc_id", "text", "taken", "target"} <= set(out.columns)


def odd_documents(spark):
    """Equal rows, ids used twice, null ids and texts, and columns named like the operators' own."""
    rng = random.Random(21)
    p, q, r = (prose(rng, 120, 100_000) for _ in range(3))
    data = [(1, p, "a"), (5, p + " x", "a"), (5, q, "b"), (5, q, "b"), (None, r, None), (None, r, "b"), (7, None, "a"), (8, " ", None), (9, q + "\n" + p, "b")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    clashing = {c: F.lit(f"own {c}") for c in ("kept", "n_words", "_text", "n_removed", "Size", "taken", "first", "component_id", "row", "k_0", "c_1", "n_chars", "text_hash", "w", "h")}
    return df.withColumns(clashing), (p, q, r)


def test_stages_of_odd_rows(spark, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([(1, " ".join(prose(random.Random(21), 120, 100_000).split()[20:60]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, (p, q, r) = odd_documents(spark)
    steps = dict(c.STAGES)
    texts = lambda df: sorted((x["doc_id"] or -1, x["text"]) for x in df.collect())
    kept = steps["quality_rules"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and texts(kept) == sorted([(1, p), (5, p + " x"), (5, q), (5, q), (-1, r), (-1, r), (9, q + "\n" + p)])
    lined = steps["line_dedup"](spark, kept, str(tmp_path))
    # the first of p and "p x", of q (both rows, one document) and of r (both rows) stay
    assert lined.columns == docs.columns and texts(lined) == sorted([(1, p), (5, q), (5, q), (-1, r), (-1, r)])
    near = steps["near_dedup"](spark, kept, str(tmp_path))
    assert near.columns == docs.columns and texts(near) == sorted([(1, p), (5, q), (-1, r), (9, q + "\n" + p)])
    clean = steps["decontaminate"](spark, kept, str(tmp_path))
    assert clean.columns == docs.columns and texts(clean) == sorted([(5, q), (5, q), (-1, r), (-1, r)])
    mixed = steps["mix_sources"](spark, kept, str(tmp_path))
    assert {"Size_in", "taken_in", "size", "taken", "kept"} <= set(mixed.columns)
    assert all(x["kept"] == "own kept" and x["taken_in"] == "own taken" and x["taken"] <= 2 * x["size"] for x in mixed.collect())
    mixed.write.parquet(str(tmp_path / "out"))


def test_stages_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    none = spark.createDataFrame([], SCHEMA)
    blank = spark.createDataFrame([(1, None, "en", "s", 0), (None, None, None, None, None), (2, "", "en", "s", 0)], SCHEMA)
    for k, (_, step) in enumerate(c.STAGES):
        assert step(spark, none, str(tmp_path)).count() == 0
        assert step(spark, blank, str(tmp_path)).count() == (0 if k in (0, 4) else 3)
