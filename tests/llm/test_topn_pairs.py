import math
import random
from collections import Counter
from itertools import combinations

import pytest

from relweave.llm import pairs as P
from relweave.llm.topn import top_n


def best(rows, n):
    groups = {}
    for g, s, t in rows:
        if g is not None and s is not None and not math.isnan(s):
            groups.setdefault(g, []).append((-s, t is None, t or 0))
    rows = [(g, -s, None if none else t, i + 1) for g, all_ in groups.items() for i, (s, none, t) in enumerate(sorted(all_)[:n])]
    return sorted(rows, key=lambda x: (x[0], x[3]))


def run_top(spark, rows, n, **kw):
    df = spark.createDataFrame([(g, s, t, "x", 0) for g, s, t in rows], "category string, price double, product_id long, rank string, have long")
    got = [(r["category"], r["price"], r["product_id"], r["rank"]) for r in top_n(df, "category", "price", "product_id", n, **kw).collect()]
    return sorted(got, key=lambda x: (x[0], x[3]))


@pytest.mark.parametrize("n,shares", [(5, None), (1, (0.5,)), (3, (0.01, 0.02, 0.9)), (4, ())])
def test_top_n(spark, n, shares):
    rnd = random.Random(n)
    rows = [(rnd.choice(["a", "a", "a", "b", "c", None, "", "d%d" % rnd.randint(0, 40)]), rnd.choice([None, math.nan, -1.0, 0.0, 5.0, 5.0, 7.5, rnd.random() * 100]), rnd.choice([None, 1, 2, rnd.randint(0, 500)])) for _ in range(900)]
    got = run_top(spark, rows, n, **({} if shares is None else {"shares": shares}))
    assert got == best(rows, n)


def test_top_n_of_ties_and_nothing(spark):
    rows = [("a", 5.0, i) for i in range(300)] + [("b", math.inf, 1), ("b", -math.inf, 2)]
    assert run_top(spark, rows, 5) == [("a", 5.0, i, i + 1) for i in range(5)] + [("b", math.inf, 1, 1), ("b", -math.inf, 2, 2)]
    assert run_top(spark, [], 5) == []
    assert run_top(spark, [("a", None, 1)], 5) == []


def count_pairs(rows, m):
    baskets = {}
    for k, i in rows:
        if k is not None and i is not None:
            baskets.setdefault(k, set()).add(i)
    n = Counter(i for b in baskets.values() for i in b)
    both = Counter(p for b in baskets.values() for p in combinations(sorted(b), 2))
    return {(a, b, c, n[a], n[b], len(baskets)) for (a, b), c in both.items() if c >= m}


def run_pairs(spark, rows, **kw):
    df = spark.createDataFrame([(k, i, 1, 2) for k, i in rows], "order_id long, product_id long, n long, a long")
    out = P.cooccurring(df, "order_id", "product_id", **kw).collect()
    for r in out:
        assert math.isclose(r["lift"], r["n_ab"] * r["n_baskets"] / (r["n_a"] * r["n_b"]))
    got = [tuple(r)[:6] for r in out]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("m,heavy", [(1, 4), (2, 0), (2, 3), (3, 50), (5, 8)])
def test_pairs(spark, m, heavy):
    rnd = random.Random(m * 10 + heavy)
    rows = []
    for k in range(300):
        rows += [(k, min(int(rnd.paretovariate(0.7)), 60)) for _ in range(rnd.choice([1, 2, 3, 6, 20]))]
    rows += rows[:50] + [(None, 1), (5, None), (None, None)]
    assert run_pairs(spark, rows, min_count=m, heavy=heavy) == count_pairs(rows, m)


def test_large_baskets(spark, monkeypatch):
    monkeypatch.setattr(P, "GIANT", 60)
    monkeypatch.setattr(P, "BLOCK", 16)
    rnd = random.Random(2)
    rows = [(k, i) for k in range(4) for i in rnd.sample(range(200), 90)] + [(k, i) for k in range(10, 60) for i in rnd.sample(range(200), 12)]
    for m in (1, 2, 3, 5):
        assert run_pairs(spark, rows, min_count=m, heavy=6) == count_pairs(rows, m)


def test_one_basket_and_empty_table(spark):
    assert run_pairs(spark, [], min_count=1) == set()
    assert run_pairs(spark, [(1, 1)], min_count=1) == set()
    assert run_pairs(spark, [(1, i) for i in range(20)], min_count=1, heavy=2) == count_pairs([(1, i) for i in range(20)], 1)


def test_matrices_follow_each_other():
    count = P._popcounts(3)
    old, P.MATRIX = P.MATRIX, 4
    try:
        k = [1, 1, 2, 3, 3, 3, 4, 5, 5, 9, 9, 10, 10]
        j = [0, 1, 2, 0, 1, 2, 0, 1, 2, 0, 1, 0, 2]
        batches = [P.pa.RecordBatch.from_arrays([P.pa.array(k[a:b]), P.pa.array(j[a:b], P.pa.int32())], ["k", "j"]) for a, b in ((0, 1), (1, 6), (6, 6), (6, 13))]
        got = Counter()
        for out in count(iter(batches)):
            for a, b, n in zip(*(c.to_pylist() for c in out.columns)):
                got[a, b] += n
        assert got == {(0, 1): 3, (0, 2): 2, (1, 2): 2}
    finally:
        P.MATRIX = old
