from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from ringview.llm import jaccard


def brute(docs: list[tuple]) -> dict:
    """Components by comparing all pairs of texts."""
    sets = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = {i: i for i, _ in docs if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted((i if i is not None else -1, len(s), find(i) if i is not None and s else i if i is not None else -1) for i, s in sets)


def corpus(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rnd.choice(words) for _ in range(60)]
    base = [[rnd.choice(words) for _ in range(rnd.choice([3, 8, 40, 120]))] for _ in range(n // 6)]
    docs = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 8])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        if rnd.random() < 0.4:
            w = w + passage
        docs.append((i * 3, " ".join(w)))
    return docs


def result(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n string").repartition(3)
    return sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in jaccard.duplicates(df, **kw).collect())


@pytest.mark.parametrize(("seed", "kw"), [(1, {}), (2, {"common_over": 0}), (3, {"broadcast_ids": 0, "common_over": 4})])
def test_components_equal_all_pairs(spark, seed, kw) -> None:
    docs = corpus(seed, 240)
    assert result(spark, docs, **kw) == brute(docs)


def test_odd_rows(spark) -> None:
    long = " ".join(f"v{k % 977}" for k in range(20000))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "one"), (7, long), (8, long + " end"), (9, "a b c d e f"), (9, "one two"), (10, "a b c d e f"), (None, "one two"), (4, "one two")]
    got = result(spark, docs)
    by_id = defaultdict(set)
    for i, _, c in got:
        by_id[i].add(c)
    assert len(got) == len(docs)
    assert by_id[1] == {1} and by_id[2] == {2} and by_id[3] == {3} and by_id[6] == {6} and by_id[-1] == {-1}
    assert by_id[7] == by_id[8] == {7}
    assert by_id[4] == by_id[5] == by_id[9] == by_id[10] == {4}


def test_one_of_each_group_stays(spark) -> None:
    docs = spark.createDataFrame([(1, "a b c d e f g", 1), (2, "a b c d e f g", 2), (3, None, 3), (4, None, 4)], "doc_id long, text string, component_id int")
    assert sorted(r["doc_id"] for r in jaccard.drop_duplicates(docs).collect()) == [1, 3, 4]


def test_rows_that_repeat_an_id_are_one_document(spark) -> None:
    rows = [(5, "", "p"), (5, "a b c d e f", "q"), (2, "a b c d e f", "r"), (7, "x y", "s"), (7, "x y", "t"), (8, "o n e", "u"), (8, "t w o", "v"), (None, "x y", "w"), (None, "x y", "w"), (9, None, "x"), (9, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in jaccard.duplicates(docs).collect()) == sorted(
        [(5, 0, 2), (5, 2, 2), (2, 2, 2), (7, 1, 7), (7, 1, 7), (8, 1, 8), (8, 1, 8), (-1, 1, -1), (-1, 1, -1), (9, 0, 9), (9, 0, 9)]
    )
    for limit in (10, 0):
        kept = jaccard.drop_duplicates(docs, broadcast_ids=limit)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == [(-1, "x y"), (-1, "x y"), (2, "a b c d e f"), (5, ""), (7, "x y"), (8, "o n e"), (8, "t w o"), (9, "")]


def test_bands_hold_every_size_that_can_link() -> None:
    for n in range(1, 700):
        for m in range(n, 100 * n // 80 + 1):
            assert m.bit_length() in jaccard.bands(n, 80) and m.bit_length() in jaccard.bands(m, 80)


def test_empty(spark) -> None:
    assert jaccard.duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bit_counts_bound_the_overlap() -> None:
    rng = np.random.default_rng(1)
    for size in (1, 50, 1500, 5000):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: size // 2], rng.integers(0, 2**63, size // 3).astype(np.uint64)]))
        if len(b):
            assert len(np.intersect1d(a, b)) <= jaccard.most_shared(jaccard.signature(a), jaccard.signature(b), len(a), len(b)) <= min(len(a), len(b))
