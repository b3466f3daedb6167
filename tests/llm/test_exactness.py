"""Rows that a weaker form of the similarity operators gets wrong: clashing hashes and ids, hot buckets, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, WORD, near_brute, prose, union_find


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_of_equal_polynomials(spark):
    """Words that any polynomial hash modulo a power of two confuses are told apart."""
    from foliant.llm.minhash_dedup import near_duplicates
    from foliant.llm.quality import quality_rules

    a, b = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    text = " ".join(w for k in range(10) for w in (a, b, f"x{k}", a, a, f"y{k}", b, b)[:8])
    df = spark.createDataFrame([(1, a), (2, b), (3, a), (4, " ".join(f"{(a, b)[i % 2]} u{i} u{i + 1} v{i}" for i in range(40))), (5, text)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    one = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules(df).collect()}
    assert one[4] == 0


def test_ids_used_twice(spark):
    """Equal ids with different texts join nothing; ids of any type; one row of a component is first."""
    from foliant.llm.minhash_dedup import near_duplicates

    p, q = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    data = [(1, p), (5, p + " x"), (5, q), (6, q), (None, q), (7, p), (7, p), (8, None), (None, "z y"), (None, "z y")]
    for kind in ("long", "string"):
        df = spark.createDataFrame([(None if i is None else str(i) if kind == "string" else i, t, n) for n, (i, t) in enumerate(data)], f"doc_id {kind}, text string, KEPT int")
        got = {r["KEPT_in"]: r for r in near_duplicates(df, keep=("KEPT",), single=True).collect()}
        name = str if kind == "string" else int
        assert [got[n]["component_id"] for n in range(10)] == [name(1), name(1), name(5), name(5), name(5), name(1), name(1), name(8), None, None]
        assert [got[n]["kept"] for n in range(10)] == [True, False, True, False, False, False, False, True, True, True]
        assert [n for n in range(8) if got[n]["first"]] == [0, 2, 7] and got[8]["first"] != got[9]["first"]


@pytest.mark.parametrize("most", [3, 12, 4096])
def test_no_link_of_a_hot_bucket_is_lost(spark, monkeypatch, most):
    """All items share one band only: pairs in it are found whatever the bucket's size, the stars aside."""
    import numpy as np
    import pyarrow as pa

    from foliant.llm import _lsh
    from foliant.llm._common import Stage, exact_shingles
    from foliant.llm.minhash_dedup import sets_of

    monkeypatch.setattr(_lsh, "MOST", most)
    monkeypatch.setattr(_lsh, "BLOCK", 4)
    rng = random.Random(1)
    template = prose(rng, 25, 10_000)
    texts = []
    for k in range(24):  # half of each text is shared; every third pair is similar
        own = prose(rng, 40, 10_000)
        texts += [template + " " + own, template + " " + own + " end"] if k % 3 == 0 else [template + " " + own]
    bands = [[7, 1000 * i + 1, 1000 * i + 2] for i in range(len(texts))]
    items = spark.createDataFrame([(i, b, bytearray(bytes(16))) for i, b in enumerate(bands)], "id long, bands array<long>, signature binary")
    bodies = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    stage = Stage(spark)
    sets = _lsh.Sets(lambda c: sets_of(c, 4), lambda c: exact_shingles(c, 4))
    found = _lsh.similar_components(stage, items, lambda ids: stage.put(bodies.join(ids, "id", "left_semi")), sets, 80, 0.5, 100)
    _, want = near_brute(enumerate(texts), 4, 80)
    got = {r["node"]: r["component"] for r in found.collect()}
    assert all(got.get(i, i) == c for i, c in want.items()) and sum(want[i] != i for i in want) == 8
    assert np.array_equal(*(x for x in exact_shingles(pa.array([texts[0], texts[0]]), 4)))


def test_exact_shingles():
    import pyarrow as pa

    from foliant.llm._common import exact_shingles

    rng = random.Random(6)
    texts = [None, "", "a", "b", "A b", "a B c", *(" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 30))) for _ in range(40))]
    for width in (1, 2, 3, 4, 5, 7):
        sets, _ = near_brute(enumerate(texts), width, 80)
        got = exact_shingles(pa.array(texts), width)
        for i in range(len(texts)):
            for j in range(i + 1):
                assert len(set(got[i]) & set(got[j])) == len(sets[i] & sets[j])


def test_recall_of_planted_pairs(spark):
    """Pairs at similarity 0.8 to 0.85: the banding finds all but 1 in 1,000 at least."""
    from foliant.llm.minhash_dedup import near_duplicates

    rng, data, pairs = random.Random(12), [], []
    for k in range(400):
        w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        x = list(w)
        for at in (20, 70, 120, 170, 195)[: rng.randrange(4, 6)]:
            x[at] += "q"
        data += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(x))]
    sets, _ = near_brute(data[:2], 4, 80)
    for k in range(400):
        sets, _ = near_brute(data[2 * k : 2 * k + 2], 4, 80)
        share = len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1])
        if 0.8 <= share <= 0.85:
            pairs.append(k)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    found = sum(got[2 * k + 1] == 2 * k for k in pairs)
    assert len(pairs) > 250 and found >= 0.999 * len(pairs)


def test_line_ids(spark):
    """The id and check of a line are the same in the workers as in the plan."""
    from foliant.llm.line_dedup import _lines, _signed_lines, line_check

    df = spark.createDataFrame([(1, "some line\nzé ü\n\nsome line", "en", "s", 0)], SCHEMA)
    a = {(r["id"], r["check"]) for r in _lines(df, "text").where("line != ''").select("id", line_check("line").alias("check")).collect()}
    b = {(r["id"], r["check"]) for r in _signed_lines(df, "doc_id", "text", 8, "bigint").collect()}
    assert a == b and len(a) == 2


def test_without_lines(spark):
    from foliant.llm.line_dedup import without_lines

    rng = random.Random(3)
    texts = [None, "", "\n", "a", "a\n", "\na", *("\n".join(rng.choice(["", "x", "éé", "long line"]) for _ in range(rng.randrange(1, 8))) for _ in range(60))]
    numbers = [None if rng.random() < 0.2 or t is None else rng.sample(range(t.count("\n") + 1), rng.randrange(1, t.count("\n") + 2)) for t in texts]
    got = without_lines(spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(zip(texts, numbers, strict=True))], "i int, text string, gone array<int>"))
    assert got.columns == ["i", "text", "n_lines", "n_removed"]
    for r in got.collect():
        t, drop = texts[r["i"]], numbers[r["i"]]
        lines = [] if t is None else t.split("\n")
        left = [x for k, x in enumerate(lines) if k not in (drop or [])]
        assert (r["text"], r["n_lines"], r["n_removed"]) == (None if t is None else "\n".join(left), len(lines), len(lines) - len(left))


def test_line_recall_and_hot_template(spark, monkeypatch):
    """Lines of one template, most of them below the threshold of each other, against brute force."""
    from foliant.llm import _lsh
    from foliant.llm.line_dedup import fuzzy_line_dedup

    monkeypatch.setattr(_lsh, "MOST", 8)
    rng = random.Random(4)
    lines = [f"Copyright {rng.randrange(1990, 2026)} the authors of {prose(rng, 2, 60)}, all rights reserved by them and by those who come after them, whoever they are, in all lands" for _ in range(150)]
    sets = [{x[k : k + 8] for k in range(len(x) - 7)} for x in lines]
    links = [(a, b) for b in range(len(lines)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    component = union_find(range(len(lines)), links)
    got = fuzzy_line_dedup(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(lines)], SCHEMA), keep=("text", "source")).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in got] == [int(component[i] != i) for i in range(len(lines))]
    assert 1 < len(set(component.values())) < 145 and got[0]["text_in"] == lines[0] and WORD.search(got[0]["text"])


def test_carried_names():
    from foliant.llm._common import carried

    assert carried(["a", "Kept", "kept_in", "x"], ["doc_id", "kept"]) == [("a", "a"), ("Kept", "Kept_in"), ("kept_in", "kept_in_in"), ("x", "x")]


@pytest.mark.parametrize("width", [1, 3, 8, 9])
def test_line_shingles(width):
    """Values are equal exactly where the strings are; narrow lines need no exact sets."""
    import numpy as np
    import pyarrow as pa

    from foliant.llm._lsh import Sets, similar_pairs
    from foliant.llm.line_dedup import exact_sets, line_shingles, sets_of, unhashed

    rng = random.Random(width)
    lines = [None, "", "a", "é", "€", "a€", "x" * width, "x" * (width + 1), *("".join(rng.choice("aabé" if k % 2 else "ab€😀") for _ in range(rng.randrange(0, 40))) for k in range(80))]
    (values, owner), certain = line_shingles(pa.array(lines), width), unhashed(pa.array(lines), width)
    named = {}
    for i, line in enumerate(lines):
        line = line or ""
        want = {line[k : k + width] for k in range(len(line) - width + 1)} or ({line} if line else set())
        got = values[owner == i].tolist()
        assert len(set(got)) == len(want) and len(got) == max(len(line) - width + 1, int(bool(line)))
        for k in range(len(line) - width + 1):
            assert named.setdefault(line[k : k + width], got[k]) == got[k]
        assert certain[i] == (width <= 8 and len(line) >= width and all(ord(c) < 256 for c in line))
    assert len(set(named.values())) == len(named)
    sets = Sets(lambda c: sets_of(c, width), lambda c: exact_sets(c, width), lambda c: unhashed(c, width))
    left, right = np.triu_indices(len(lines), 1)
    own = [({x[k : k + width] for k in range(len(x) - width + 1)} or ({x} if x else set())) for x in (t or "" for t in lines)]
    want = [bool(own[a]) and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]) for a, b in zip(left, right, strict=True)]
    assert similar_pairs(pa.array(lines), left, right, sets, 80).tolist() == want
