import random

import numpy as np
import pytest

from relweave.llm import spans as S


def brute(docs, k):
    """Spans by a table of all windows; texts of one id are one document."""
    where = {}
    for d, t in docs:
        if d is None or t is None:
            continue
        for i in range(len(t) - k + 1):
            where.setdefault(t[i : i + k], set()).add(d)
    covered = {}
    for d, t in docs:
        if d is None or t is None:
            continue
        for i in range(len(t) - k + 1):
            if len(where[t[i : i + k]]) > 1:
                covered.setdefault(d, set()).add(i)
    out = []
    for d, starts in covered.items():
        s = e = None
        for i in sorted(starts):
            if e is not None and i <= e:
                e = i + k
            else:
                if e is not None:
                    out.append((d, s, e))
                s, e = i, i + k
        out.append((d, s, e))
    return sorted(out)


def run(spark, docs, k, g=None):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, first string, n long")
    return sorted(map(tuple, S.shared_spans(df, k=k, g=g).collect()))


def corpus(seed, n=60, alphabet="abcdeé日🙂 "):
    rnd = random.Random(seed)
    text = lambda m: "".join(rnd.choice(alphabet) for _ in range(m))
    shared = [text(rnd.randint(5, 60)) for _ in range(6)]
    docs = [(i, "".join(text(rnd.randint(0, 30)) if rnd.random() < 0.6 else rnd.choice(shared)[rnd.randint(0, 8) :] for _ in range(rnd.randint(0, 6)))) for i in range(n)]
    return docs + [(1000, None), (1001, ""), (1002, "a"), (None, shared[0]), (3, docs[3][1]), (1003, "a" * 200), (1004, "a" * 50), (1005, "abab" * 40)]


@pytest.mark.parametrize("k,g", [(12, None), (12, 12), (12, 1), (20, 10), (7, 3)])
def test_random_corpora(spark, k, g):
    docs = corpus(k * 31 + (g or 0))
    assert run(spark, docs, k, g) == brute(docs, k)


def test_pieces_of_long_texts(spark, monkeypatch):
    # the cutter runs in workers, so the piece length is tried on the function itself
    texts = [t for _, t in corpus(5) if t and len(t) >= 12]
    whole = S._runs(texts, 12, 6)
    assert int(whole[2].sum()) == sum(len(t) - 11 for t in texts)
    for of, first, n in zip(whole[0], whole[1], whole[2]):
        assert 0 <= first and first + n + 11 <= len(texts[of])


def test_blocks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    docs = corpus(77, n=40)
    assert run(spark, docs, 12) == brute(docs, 12)


def test_copies_hold_most_rows(spark):
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    docs = [(i, text) for i in range(300)] + [(1000 + i, "".join(rnd.choice("abcdefgh ") for _ in range(80))) for i in range(200)]
    assert run(spark, docs, 40) == [(i, 0, 300) for i in range(300)]


def test_common_phrase_in_different_texts(spark):
    rnd = random.Random(9)
    noise = lambda m: "".join(rnd.choice("abcdefghijkl") for _ in range(m))
    docs = [(i, noise(rnd.randint(0, 90)) + " the phrase that everyone uses " + noise(rnd.randint(0, 90))) for i in range(120)]
    assert run(spark, docs, 24) == brute(docs, 24)


def test_repetition_within_one_document_and_empty_tables(spark):
    assert run(spark, [(1, "abcdefghij" * 30), (2, "unlike it")], 20) == []
    assert run(spark, [], 20) == []


def test_gram_hashes_depend_on_the_gram_only():
    codes = np.array([ord(c) for c in "xyabcdefgzabcdefgq"], np.uint32)
    for g in (1, 2, 3, 5, 7):
        h = S.gram_hashes(codes, g)
        assert len(h) == len(codes) - g + 1
        assert h[2] == h[10] and len(set(h.tolist())) == len({bytes(codes[i : i + g]) for i in range(len(codes) - g + 1)})


def test_amounts(spark):
    docs = spark.createDataFrame([(1, "abcdefghijklmn"), (2, "abcdefghijkl"), (3, None), (4, ""), (5, "zz")], "doc_id long, text string")
    got = {r["doc_id"]: (r["shared_chars"], round(r["share"], 4)) for r in S.shared_amounts(docs, S.shared_spans(docs, k=6)).collect()}
    assert got == {1: (12, round(12 / 14, 4)), 2: (12, 1.0), 3: (0, 0.0), 4: (0, 0.0), 5: (0, 0.0)}


def test_texts_with_one_fingerprint_are_found_and_refused(spark, monkeypatch):
    """With no bits of the fingerprints left, all runs of one minimizer count as the same until their texts are compared."""
    docs = [(1, "zzzzabcdefghzzzzz"), (2, "yabcdefghyyyyy"), (3, "xxabcdefghxx"), (4, "wwabcdefghww")]
    want = brute(docs, 10)
    docs += [(5, "qqabcdefghrr"), (6, "abcdefghrr qq")]
    want = brute(docs, 10)
    monkeypatch.setattr(S, "ATTEMPTS", ((0, 0),))
    with pytest.raises(S.Clash, match="different texts"):
        run(spark, docs, 10, 8)
    monkeypatch.setattr(S, "ATTEMPTS", ((0, 0), (1, 0), (2, -1)))
    assert run(spark, docs, 10, 8) == want


def test_windows_with_one_fingerprint_are_refused(spark, monkeypatch):
    """Branches whose windows are told apart by no bit."""
    rnd = random.Random(17)
    noise = lambda m: "".join(rnd.choice("abcdefghijkl") for _ in range(m))
    docs = [(i, noise(20) + " the phrase that everyone uses " + noise(20)) for i in range(40)]
    monkeypatch.setattr(S, "ATTEMPTS", ((0, 7), (1, -1)))
    assert run(spark, docs, 24) == brute(docs, 24)


def path_rows(spark, docs, k, g=None):
    df = spark.createDataFrame(docs, "doc long, text string")
    df = df.selectExpr("doc", "xxhash64(text) as rid", "text")
    seen = []
    paths = S._paths

    def kept(*args):
        seen.append(paths(*args))
        return seen[-1]

    S._paths = kept
    try:
        S._shared(df, k, g or k // 2, 0, -1).count()
    finally:
        S._paths = paths
    return sorted((r["doc"], r["s"], r["n"] * r["times"]) for r in seen[0].select("doc", "s", "n", "times").collect())


def test_runs_are_joined_to_paths(spark):
    rnd = random.Random(23)
    noise = lambda m: "".join(rnd.choice("abcdefghijklmnop") for _ in range(m))
    one, two = noise(400), noise(300)
    # two documents share a long passage: one path a copy, though it takes many runs
    rows = path_rows(spark, [(1, noise(50) + one + noise(50)), (2, noise(70) + one + noise(30)), (3, noise(200))], 40)
    assert len(rows) == 2 and all(n > 3 * 21 for _, _, n in rows) and rows[0][2] == rows[1][2]
    # a third leaves in the middle: all copies are cut where it does
    rows = path_rows(spark, [(1, one), (2, one), (3, one[:200] + noise(80))], 40)
    assert len(rows) == 5 and sorted(d for d, _, _ in rows) == [1, 1, 2, 2, 3]
    assert sum(n for d, _, n in rows if d == 1) == len(one) - 39
    # copies of a whole text are one path each
    rows = path_rows(spark, [(i, two) for i in range(6)], 40)
    assert rows == [(i, 0, len(two) - 39) for i in range(6)]
    # a loop in a text that repeats itself has a beginning
    loop = noise(70) * 5
    rows = path_rows(spark, [(1, loop), (2, loop)], 40)
    assert {(d, sum(n for e, _, n in rows if e == d)) for d, _, _ in rows} == {(1, len(loop) - 39), (2, len(loop) - 39)}


def test_paths_that_follow_themselves(spark, monkeypatch):
    docs = [(1, "b" + "a" * 700), (2, "a" * 500 + "c"), (3, "xyz" * 150 + "q"), (4, "zxyzx" + "xyz" * 90), (5, "a" * 30), (6, "no" * 9)]
    rows = path_rows(spark, docs, 20)
    assert sum(n for d, _, n in rows if d == 1) == 681 and len([r for r in rows if r[0] == 1]) <= 3 and len([r for r in rows if r[0] == 3]) <= 6
    want = brute(docs, 20)
    assert run(spark, docs, 20) == want
    monkeypatch.setattr(S, "PIECE", 32)
    monkeypatch.setattr(S, "BLOCK", 50)
    assert run(spark, docs, 20) == want


def test_paths_longer_than_a_piece_and_a_block(spark, monkeypatch):
    rnd = random.Random(29)
    noise = lambda m: "".join(rnd.choice("abcdefghijklmnop🙂") for _ in range(m))
    one = noise(500)
    docs = [(1, noise(90) + one + noise(10)), (2, noise(31) + one), (3, noise(300)), (4, one[100:350] + noise(40) + one[:60])]
    want = brute(docs, 24)
    monkeypatch.setattr(S, "PIECE", 32)
    monkeypatch.setattr(S, "BLOCK", 50)
    assert run(spark, docs, 24) == want


def test_only_texts_that_are_needed_are_cut(spark):
    rnd = random.Random(37)
    noise = lambda m: "".join(rnd.choice("abcdefghijklmnop") for _ in range(m))
    texts = spark.createDataFrame([(i, noise(100)) for i in range(300)], "doc long, text string").selectExpr("doc", "xxhash64(text) as rid", "text")
    places = texts.filter("doc % 100 = 7").selectExpr("doc", "rid", "5 as s", "3 as w", "1L as anchor")
    cuts = S._cut(texts, places, 20)
    assert {(r["doc"], r["cut"]) for r in cuts.collect()} == {(r["doc"], r["text"][5:27]) for r in texts.filter("doc % 100 = 7").collect()}
    lost = places.selectExpr("doc", "rid + 1 as rid", "s", "w", "anchor")
    assert S._cut(texts, lost, 20).filter("cut is null").count() == 3
    past = places.selectExpr("doc", "rid", "90 as s", "w", "anchor")
    assert S._cut(texts, past, 20).filter("cut is null").count() == 3
