import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from relweave.llm import bpe as B
from relweave.llm import tokens as K

tiktoken = pytest.importorskip("tiktoken")
MERGES = K.load_merges()
ENC = tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=MERGES.ranks, special_tokens={})
ENCODER = B.Encoder(MERGES)
TRICKY = ["", " ", "  a  b ", "\n\n\t x\r\n", "don't we'll 're 'S it's", "<|endoftext|> <|endoftext|>", "a" * 500, " " * 300 + "x", "é" * 90, "é‍­‮", "🙂🇸🇪👩‍👩‍👧", "日本語のテキスト", "12345 ½²", "\x00\x1f\x85 x", "-" * 200 + "=" * 99, "��", "'" * 50]


@pytest.mark.parametrize("text", TRICKY)
def test_as_the_public_encoder(text):
    assert list(ENCODER.encode(text)) == ENC.encode_ordinary(text)


@given(st.text(max_size=300))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    ids = ENC.encode_ordinary(text)
    assert list(ENCODER.encode(text)) == ids
    assert B.Decoder(MERGES).decode(ids) == text


def test_slices_of_any_size():
    rnd = random.Random(3)
    parts = ["don't", " ", "  ", "\n", "word", "élan", "1234", "!!", "'s", "'", "r", "e", "日本", "x" * 40, " " * 40, "-" * 40, "7" * 40, "🙂"]
    for n in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25)))
        want = ENC.encode_ordinary(text)
        for size in (1, 2, 3, 5, 16):
            got = list(B.Encoder(MERGES, slice_chars=size, block=8).encode(text))
            assert got == want, (text, size)


def test_transducer_is_stable_and_bounded():
    rnd = random.Random(5)
    ahead = MERGES.lookahead()
    assert 1 < ahead < 4096
    common = [t for t in MERGES.ranks if len(t) > 1]
    for _ in range(60):
        piece = b"".join(rnd.choice(common) if rnd.random() < 0.5 else bytes([rnd.choice(b"ae -=0\xc3\xa9")]) for _ in range(300))
        t, out, most = B.Transducer(MERGES, block=16), [], 0
        for i in range(0, len(piece), 7):
            out += t.push(piece[i : i + 7])
            most = max(most, len(t.held))
        out += t.finish()
        assert out == [MERGES.ranks[x] for x in MERGES.merge(piece)]
        assert most <= 16 + ahead + 16 + max(map(len, MERGES.ranks))


def test_long_runs_of_one_character():
    for c in ("a", " ", "=", "9", "é", "日", "\n"):
        text = "x " + c * 3000 + " y" + c * 2001
        assert list(B.Encoder(MERGES, slice_chars=64, block=128).encode(text)) == ENC.encode_ordinary(text)


def test_both_merge_loops_agree():
    rnd = random.Random(8)
    for _ in range(300):
        piece = bytes(rnd.choice(b"abcdefthe in\xe2\x80\x94") for _ in range(rnd.randint(1, 120)))
        assert MERGES._merge_short(piece, None) == MERGES._merge_long(piece, None)


def test_decoder_takes_ids_one_by_one():
    text = "日本🙂é x"
    d = B.Decoder(MERGES)
    assert "".join(d.push([i]) for i in ENC.encode_ordinary(text)) + d.finish() == text
    assert B.Decoder(MERGES).decode(ENC.encode_ordinary("🙂")[:1]) == "�"


def test_corpus(spark):
    rows = [(i, t, 7) for i, t in enumerate(TRICKY)] + [(99, None, 7), (99, None, 7), (None, "x", 7), (98, "long " * 40_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    enc = K.encode_corpus(docs)
    got = {(r["doc_id"], tuple(r["ids"])) for r in enc.collect()}
    assert got == {(i, tuple(ENC.encode_ordinary(t or ""))) for i, t, _ in rows}
    assert enc.count() == len(rows)
    back = {(r["doc_id"], r["text"]) for r in K.decode_corpus(enc).collect()}
    assert back == {(i, t or "") for i, t, _ in rows}
    assert K.encode_corpus(docs.limit(0)).count() == 0


def test_every_piece_goes_through_the_transducer(monkeypatch):
    """Of a corpus, with the table of pieces switched off: as many pieces as the transducer ended, and ids given before a long piece ended."""
    ended, early = [], []
    finish, push = B.Transducer.finish, B.Transducer.push

    def counted_push(self, data):
        ids = list(push(self, data))
        early.extend(ids)
        return ids

    def counted_finish(self):
        ended.append(1)
        return finish(self)

    monkeypatch.setattr(B.Transducer, "push", counted_push)
    monkeypatch.setattr(B.Transducer, "finish", counted_finish)
    monkeypatch.setattr(B.Encoder, "__setitem__", lambda self, piece, ids: None)
    texts = [t for t in TRICKY if t] + ["short words only", "日本語" * 500, "x" * 40_000, "words and " * 5_000]
    encoder = B.Encoder(MERGES)
    for text in texts:
        ended.clear(), early.clear()
        assert list(encoder.encode(text)) == ENC.encode_ordinary(text)
        assert len(ended) == len(B._SPLIT.findall(text)), text[:40]
        assert bool(early) == any(len(p.encode()) > B.BLOCK + MERGES.lookahead() for p in B._SPLIT.findall(text)), text[:40]
    assert not encoder


def test_the_table_only_remembers():
    once, again = B.Encoder(MERGES), B.Encoder(MERGES)
    for text in TRICKY * 2:
        again.encode(text)
    assert all(list(ids) == list(once.encode(piece)) and len(piece.encode()) <= MERGES.lookahead() for piece, ids in again.items())


def test_lists_with_tokens_that_no_merge_reaches_are_refused():
    single = {bytes([i]): i for i in range(256)}
    assert B.MergeList(single | {b"ab": 256, b"abc": 257}).lookahead() >= 1
    with pytest.raises(ValueError, match="no merge reaches"):
        B.MergeList(single | {b"abc": 256}).lookahead()
    with pytest.raises(ValueError, match="no merge reaches"):
        B.MergeList(single | {b"bc": 256, b"ab": 257, b"abcd": 258}).lookahead()
    with pytest.raises(ValueError, match="no token for the bytes"):
        B.MergeList({b"a": 0}).lookahead()


def test_random_merge_lists_by_slices():
    """Well-formed lists: what comes piece by piece is what the whole merge gives."""
    rnd = random.Random(12)
    for _ in range(150):
        ranks = {bytes([i]): i for i in range(256)}
        pool = [b"a", b"b", b"c"]
        for _ in range(rnd.randint(1, 14)):
            token = rnd.choice(pool) + rnd.choice(pool)
            if token not in ranks and len(B.MergeList(ranks | {token: 1 << 20}).merge(token)) == 1:
                ranks[token] = 256 + len(ranks)
                pool.append(token)
        merges = B.MergeList(ranks)
        piece = bytes(rnd.choice(b"abc") for _ in range(400))
        t = B.Transducer(merges, block=rnd.randint(1, 9))
        ids = [*t.push(piece[:150]), *t.push(piece[150:]), *t.finish()]
        assert ids == [ranks[x] for x in merges.merge(piece)]
