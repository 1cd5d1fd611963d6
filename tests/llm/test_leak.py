import random
import unicodedata

import regex

from relweave.llm import leak as L


def plain_words(text):
    return [w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFKC", text))]


def brute(docs, items, m):
    out = set()
    for i, p in items:
        if i is None or p is None:
            continue
        a = plain_words(p)
        grams = {tuple(a[x : x + m]) for x in range(len(a) - m + 1)}
        for d, t in docs:
            if d is None or t is None:
                continue
            b = plain_words(t)
            if any(tuple(b[x : x + m]) in grams for x in range(len(b) - m + 1)):
                out.add((i, d))
    return out


def data(seed):
    rnd = random.Random(seed)
    vocab = ["Straße", "ΟΔΟΣ", "ﬁn", "naïve", "x²", "日本", "a", "b", "İx", "c", "dd", "e9"]
    say = lambda n: rnd.choice([" ", ", ", "! ", "\n"]).join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(rnd.randint(1, 14))) for i in range(25)]
    docs = []
    for d in range(60):
        parts = [say(rnd.randint(0, 10))]
        if rnd.random() < 0.5:
            w = rnd.choice(items)[1].split(" ")
            a = rnd.randint(0, 4)
            parts += [" ".join(w[a : a + rnd.randint(2, 12)]).upper(), say(rnd.randint(0, 5))]
        docs.append((d, " ".join(parts)))
    return docs + [(100, None), (101, ""), (102, "..."), (None, items[0][1])], items + [(50, None), (51, ""), (None, "a b c d e")]


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, passage string"),
        spark.createDataFrame([(i, p, 1) for i, p in items], "item_id long, passage string, doc_id long"),
    )


def test_pairs_against_brute_force(spark):
    for seed, m in ((1, 4), (2, 5), (3, 3)):
        docs, items = data(seed)
        got = L.find_leaks(*frames(spark, docs, items), min_words=m)
        assert {(r["item_id"], r["doc_id"]) for r in got.collect()} == brute(docs, items, m)


def test_matches_are_real_and_maximal(spark):
    docs, items = data(7)
    text, passage = dict(docs), dict(items)
    rows = L.find_leaks(*frames(spark, docs, items), min_words=4).collect()
    assert rows
    for r in rows:
        a, b = plain_words(passage[r["item_id"]]), plain_words(text[r["doc_id"]])
        i, j, n = r["item_word"], r["doc_word"], r["n_words"]
        assert a[i : i + n] == b[j : j + n] and n >= 4
        assert a[i + n : i + n + 1] != b[j + n : j + n + 1] or i + n == len(a)
        assert i == 0 or j == 0 or a[i - 1] != b[j - 1]


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = data(11)
    once = sorted(map(tuple, L.find_leaks(*frames(spark, docs, items), min_words=4).collect()))
    monkeypatch.setattr(L, "BLOCK_BYTES", 300)
    assert sorted(map(tuple, L.find_leaks(*frames(spark, docs, items), min_words=4).collect())) == once


def test_small_steps_and_wide_vocabulary():
    items = [(1, " ".join(f"w{i}" for i in range(5000))), (2, " ".join(f"w{i}" for i in range(100, 140)))]
    index = L.TestIndex(items, 12)
    codes = L.np.array([index.vocab[f"w{i}"] for i in range(90, 160)] + [0] + [index.vocab[f"w{i}"] for i in range(4988, 5000)])
    whole = sorted(zip(*map(L.np.ndarray.tolist, index.search(codes))))
    assert whole == [(90, 0, 70), (4988, 71, 12), (5001, 10, 40)]
    step, L.STEP = L.STEP, 3
    try:
        assert sorted(zip(*map(L.np.ndarray.tolist, index.search(codes)))) == whole
    finally:
        L.STEP = step


def test_empty_sides_and_removal(spark):
    docs, items = frames(spark, [(1, "a b c d e f"), (2, "z"), (None, "a b c d e f")], [(9, "A, b. C d")])
    found = L.find_leaks(docs, items, min_words=4)
    assert [tuple(r) for r in found.collect()] == [(9, 1, 0, 0, 4)]
    assert sorted((r["doc_id"] or 0) for r in L.drop_leaked(docs, found).collect()) == [0, 2]
    assert L.find_leaks(docs, items.limit(0), min_words=4).count() == 0
    assert L.find_leaks(docs.limit(0), items, min_words=4).count() == 0


def longest(items, docs, m):
    """The longest shared run of each passage and document, by trying all pairs of places."""
    out = {}
    for i, p in items:
        for d, t in docs:
            a, b = plain_words(p or ""), plain_words(t or "")
            best = 0
            row = [0] * (len(b) + 1)
            for x in range(len(a) - 1, -1, -1):
                row = [row[y + 1] + 1 if a[x] == b[y] else 0 for y in range(len(b))] + [0]
                best = max(best, *row)
            if best >= m and i is not None and d is not None:
                out[i, d] = best
    return out


def test_longest_run_of_each_pair(spark):
    for seed, m in ((21, 3), (22, 4)):
        docs, items = data(seed)
        rows = L.find_leaks(*frames(spark, docs, items), min_words=m).collect()
        assert {(r["item_id"], r["doc_id"]): r["n_words"] for r in rows} == longest(items, docs, m)
        assert len(rows) == len({(r["item_id"], r["doc_id"]) for r in rows})


def test_suffix_order_beyond_the_first_words():
    rnd = random.Random(31)
    for n, kinds in ((0, 3), (1, 1), (300, 2), (400, 3), (900, 40)):
        codes = L.np.array([rnd.randint(0 if rnd.random() < 0.3 else 1, kinds) for _ in range(n)] + [1, 2] * 40 + [0] + [1, 2] * 40, L.np.int32)
        sa, stretch = L.suffix_array(codes, 4, 6)

        def rest(i):
            stop = next((j for j in range(i, len(codes)) if codes[j] == 0), len(codes))
            return codes[i:stop].tolist()

        assert sorted(sa.tolist()) == [i for i in range(len(codes)) if len(rest(i)) >= 4]
        assert all(rest(i) <= rest(j) for i, j in zip(sa, sa[1:]))
        assert all((codes[min(i, j) : max(i, j)] != 0).all() == (s == t) for i, s in zip(sa[::7], stretch[::7]) for j, t in zip(sa[::11], stretch[::11]))


def test_repeated_words_make_no_product():
    index = L.TestIndex([(1, "word " * 3000), (2, "x y " * 1500)], 12)
    word, x, y = (index.vocab[w] for w in ("word", "x", "y"))
    looked = []
    agree, L._agree = L._agree, lambda a, i, b, j, done: looked.append(len(i)) or agree(a, i, b, j, done)
    try:
        t, c, n = index.search(L.np.array([word] * 8000 + [0] + [x, y] * 4000, L.np.int32))
    finally:
        L._agree = agree
    assert sorted(n.tolist()) == [3000, 3000]
    assert sum(looked) < 1_000_000  # 3,000 x 8,000 would be 24 million, twice


def test_documents_of_several_shards(spark, monkeypatch):
    rnd = random.Random(41)
    items = [(i, " ".join(rnd.choice("abcdef") for _ in range(40))) for i in range(20)]
    text = " ".join(rnd.choice([p, " ".join(rnd.choice("abcdefxyz") for _ in range(9))]) for _ in range(8) for _, p in rnd.sample(items, 5))
    index = L.TestIndex(items, 12)
    codes = L.np.array([index.vocab.get(w, 0) for w in plain_words(text)], L.np.int32)
    whole = sorted(zip(*map(L.np.ndarray.tolist, index.search(codes))))
    assert whole
    monkeypatch.setattr(L, "SHARD", 25)
    cut = index.search(codes)
    of = lambda t: L.np.searchsorted(index.begins, t, "right")
    # stretches differ once what matches nothing is cut out; the runs themselves are the same
    assert {(int(o), int(n)) for o, n in zip(of(cut[0]), cut[2])} >= {(int(o), max(n for t, _, n in whole if of(t) == o)) for o in of(cut[0])}
    assert set(of(cut[0]).tolist()) == {int(of(t)) for t, _, _ in whole}
    docs = [(1, text), (2, text[: len(text) // 2]), (3, items[3][1])]
    got = {(r["item_id"], r["doc_id"]): r["n_words"] for r in L.find_leaks(*frames(spark, docs, items)).collect()}
    assert got == longest(items, docs, 12)


def test_parts_are_as_large_as_they_are_said_to_be(monkeypatch):
    import pickle

    rnd = random.Random(51)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 9))) for _ in range(20_000)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(20, 200)))) for i in range(3000)]
    monkeypatch.setattr(L, "BLOCK_BYTES", 4_000_000)
    parts = list(L.index_parts(items, 12))
    assert len(parts) > 1 and [i for p in parts for i in p.items] == [i for i, _ in items]
    for p in parts:
        assert p.bytes <= 4_000_000 and len(pickle.dumps(p)) <= 4_400_000
