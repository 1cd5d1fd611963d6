"""Evaluation texts leaking into training text: suffix arrays over shards of the corpus, searched with every test suffix.

A shard is a bounded run of words of one task's documents. Its suffix array holds the places that are followed by ``min_words``
words which occur in test passages at all (no other place can match), in the order of everything that follows up to the next
word that doesn't. Every test suffix is looked up in it by binary search, first by ``min_words`` words, then by the rest: the
longest match that a stretch of a document has for a suffix stands beside the place where the suffix would be put in. So
no product of test suffixes and places is ever made, however often words repeat.

The corpus is read once and never shuffled. Only the test side travels to the tasks, in parts whose built size is checked;
a task searches its shard with one part after another.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.plans.partitioning import spread

#: Words of a shard, bytes of a part of the test side as it is built (arrays and vocabulary), and lookups made at a time.
SHARD, BLOCK_BYTES, STEP = 1_000_000, 64_000_000, 1_000_000
#: Bytes of a word number, a suffix and its key (at most), and of a vocabulary entry besides its characters; words compared at a time.
_NUMBER, _ENTRY, _CHUNK = 4, 160, 16
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(text: str) -> list[str]:
    """Maximal runs of characters of categories L and N after NFKC, each in lower case."""
    found = _WORD.findall(text if text.isascii() else unicodedata.normalize("NFKC", text))
    return "\n".join(found).lower().split("\n") if found else []


def suffix_array(codes: np.ndarray, least: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places with at least ``least`` more codes before the next 0, in the order of their suffixes up to it, and the number of the stretch of each.

    Ranks by a few packed codes are refined by doubling; each round sorts only the places that still share a rank.
    """
    edge = np.flatnonzero(np.diff(np.concatenate(([False], codes != 0, [False]))))
    first, stop = edge[::2], edge[1::2]
    long = stop - first >= least
    first, stop = first[long], stop[long]
    size = stop - first + 1  # with the 0 that ends it
    n = int(size.sum())
    stretch = np.repeat(np.arange(len(first)), size)
    place = np.arange(n) + (first - np.cumsum(size) + size)[stretch]
    left = stop[stretch] - place
    if not n:
        return place, stretch
    x = np.where(left > 0, codes[np.minimum(place, len(codes) - 1)], 0).astype(np.int64)
    h = max(1, 62 // bits)
    packed = np.zeros(n, np.int64)
    for i in range(h):
        packed <<= bits
        packed[: max(0, n - i)] |= np.where(left[: max(0, n - i)] > i, x[i:], 0)
    order = np.argsort(packed, kind="stable")
    slots, key, rank = np.arange(n), packed[order], np.empty(n, np.int64)
    while len(slots):
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
        alone = new & np.concatenate((new[1:], [True]))
        slots = slots[~alone & (left[order[slots]] >= h)]
        p = order[slots]
        key = rank[p] * (n + 1) + rank[p + h]  # p + h is at most the 0 that ends the stretch
        by = np.argsort(key, kind="stable")
        order[slots], key = p[by], key[by]
        h *= 2
    order = order[left[order] >= least]
    return place[order], stretch[order]


def _agree(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, done: int) -> np.ndarray:
    """How many codes agree from ``a[i]`` and ``b[j]`` on before a 0, if ``done`` do; both arrays end with ``_CHUNK`` zeros."""
    n, open_, step = np.full(len(i), done), np.arange(len(i)), np.arange(_CHUNK)
    while len(open_):
        x = a[(i[open_] + n[open_])[:, None] + step]
        same = (x == b[(j[open_] + n[open_])[:, None] + step]) & (x != 0)
        whole = same.all(axis=1)
        n[open_] += np.where(whole, _CHUNK, same.argmin(axis=1))
        open_ = open_[whole]
    return n


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of each range, and the number of the range of each."""
    n = high - low
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + (low - np.cumsum(n) + n)[of], of


class TestIndex:
    """Test passages as arrays of word numbers (0 is no test word) with a gap after each, and their suffixes by the first ``min_words`` words."""

    __test__ = False

    def __init__(self, items: Iterable[tuple], min_words: int) -> None:
        self.min_words, self.vocab, self.items = min_words, {}, []
        codes, self.bytes = array("i"), 0
        begins = []
        for item, passage in items:
            if len(w := words(passage)) >= min_words:
                self.items.append(item)
                begins.append(len(codes))
                codes.extend([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w])
                codes.append(0)
        self.codes = np.concatenate((np.array(codes, np.int32), np.zeros(_CHUNK, np.int32)))
        self.begins = np.array(begins, np.int64)
        self.bits = max(1, len(self.vocab).bit_length())
        gap = np.cumsum(np.concatenate(([0], self.codes == 0)))
        at = np.flatnonzero(gap[min_words:] == gap[:-min_words])
        keys = self.keys(self.codes, at)
        by = np.argsort(keys, kind="stable")
        self.starts = at[by].astype(np.int32)
        self.unique, self.group = np.unique(keys[by], return_index=True)
        self.bytes = self.codes.nbytes + self.begins.nbytes + self.starts.nbytes + self.unique.nbytes + self.group.nbytes + sum(map(len, self.vocab)) + _ENTRY * len(self.vocab)

    def keys(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ``min_words`` codes at each place, packed into bytes that sort as they do."""
        m, each = self.min_words, 64 // self.bits
        packed = np.zeros((len(at), -(-m // each)), np.uint64)
        for i in range(m):
            packed[:, i // each] = (packed[:, i // each] << np.uint64(self.bits)) | codes[at + i].astype(np.uint64)
        return packed.astype(">u8").view(f"S{8 * packed.shape[1]}").ravel()

    def lookup(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """The shard's suffix array, its stretches, and the range of it that shares ``min_words`` words with each distinct beginning of a test suffix."""
        sa, stretch = suffix_array(codes, self.min_words, self.bits)
        keys = self.keys(codes, sa)
        return sa, stretch, np.searchsorted(keys, self.unique, "left"), np.searchsorted(keys, self.unique, "right")

    def matching(self, codes: np.ndarray) -> np.ndarray:
        """A long document without the words that lie in no match, found piece by piece; pieces overlap so that no match is lost."""
        m, edge = self.min_words, np.zeros(len(codes) + 1, np.int64)
        for start in range(0, len(codes), SHARD):
            sa, _, low, high = self.lookup(codes[start : start + SHARD + m - 1])
            at = start + sa[_ranges(low, high)[0]]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + m, -1)
        return np.where(np.cumsum(edge[:-1]) > 0, codes, 0)

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest match of each passage in each stretch of test words of a shard: test position, shard position, words that agree."""
        m, none = self.min_words, tuple(np.zeros(0, np.int64) for _ in range(3))
        if len(codes) > 2 * SHARD:
            codes = self.matching(codes)
        sa, stretch, low, high = self.lookup(codes)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return none
        low, high = low[hit], high[hit]
        shard = np.concatenate((codes, np.zeros(_CHUNK, codes.dtype)))
        before = np.where(sa > 0, shard[sa - 1], 0)

        # test suffixes; where the same word stands before all their places, the suffix that begins with that word has the longer matches
        ends = np.append(self.group, len(self.starts))
        t, of = _ranges(ends[hit], ends[hit + 1])
        t = self.starts[t].astype(np.int64)
        before_t = np.where(t > 0, self.codes[t - 1], 0)
        slots, group = _ranges(low, high)
        at = np.cumsum(high - low) - (high - low)
        least, most = np.minimum.reduceat(before[slots], at), np.maximum.reduceat(before[slots], at)
        open_ = (before_t == 0) | (least[of] != before_t) | (most[of] != before_t)
        t, of, before_t = t[open_], of[open_], before_t[open_]

        # where each suffix would stand: binary search by the words after the first ones
        a, b = low[of], high[of]
        while len(unsure := np.flatnonzero(a < b)):
            mid = (a[unsure] + b[unsure]) // 2
            n = _agree(self.codes, t[unsure], shard, sa[mid], m)
            less = shard[sa[mid] + n] < self.codes[t[unsure] + n]
            a[unsure], b[unsure] = np.where(less, mid + 1, a[unsure]), np.where(less, b[unsure], mid)

        # the places of each beginning by stretch, in the order of their suffixes
        own = group * (int(stretch.max()) + 1) + stretch[slots]
        by = np.argsort(own, kind="stable")
        slots, own, group = slots[by], own[by], group[by]
        new = np.concatenate(([True], own[1:] != own[:-1]))
        lists = np.flatnonzero(new)
        list_ends = np.append(lists[1:], len(slots))
        known = (np.cumsum(new) - 1) * (len(sa) + 1) + slots
        group_lists = np.searchsorted(group[lists], np.arange(len(hit) + 1))

        found = [none]
        sizes = np.cumsum(group_lists[of + 1] - group_lists[of])
        done = 0
        while done < len(t):
            upto = max(done + 1, int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + STEP, "right")))
            which, some = _ranges(group_lists[of[done:upto]], group_lists[of[done:upto] + 1])
            some += done
            done = upto
            beside = np.searchsorted(known, which * (len(sa) + 1) + a[some])
            for j in (beside - 1, beside):
                inside = (j >= lists[which]) & (j < list_ends[which])
                i, k = some[inside], slots[j[inside]]
                maximal = (before_t[i] == 0) | (before_t[i] != before[k])
                i, k = i[maximal], k[maximal]
                found.append(self.best(t[i], sa[k], _agree(self.codes, t[i], shard, sa[k], m), stretch[k]))
        where = np.zeros(len(codes), np.int64)
        where[sa] = stretch
        t, c, n = (np.concatenate(x) for x in zip(*found))
        return self.best(t, c, n, where[c])

    def best(self, t: np.ndarray, c: np.ndarray, n: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each passage and value of ``within`` the longest match; of equally long ones the first of the passage, then of the shard."""
        owner = np.searchsorted(self.begins, t, "right")
        by = np.lexsort((c, t, -n, within, owner))
        owner, within = owner[by], within[by]
        first = by[np.concatenate(([True], (owner[1:] != owner[:-1]) | (within[1:] != within[:-1])))[: len(by)]]
        return t[first], c[first], n[first]


def index_parts(items: Iterable[tuple], min_words: int) -> Iterator[TestIndex]:
    """Indexes of at most ``BLOCK_BYTES`` each, but for a single passage that is larger; the number of parts is not bounded."""
    held: list[tuple] = []
    size, seen = 0, set()
    for item, passage in items:
        own = words(passage)
        cost = len(own) * (2 * _NUMBER + 8 + 8 * -(-min_words // 2)) + sum(len(x) + _ENTRY for x in set(own) - seen)
        if held and size + cost > BLOCK_BYTES:
            yield TestIndex(held, min_words)
            held, seen = [], set()
            size, cost = 0, len(own) * (2 * _NUMBER + 8 + 8 * -(-min_words // 2)) + sum(len(x) + _ENTRY for x in set(own))
        held.append((item, passage))
        seen.update(own)
        size += cost
    if held:
        yield TestIndex(held, min_words)


def _searcher(parts: list, names: list[str], min_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            number: defaultdict[str, int] = defaultdict(count(1).__next__)  # of the shard's own words; 0 is the gap between documents
            codes = array("i")
            rows: list[int] = []
            starts: list[int] = []

            def flush() -> Iterator[pa.RecordBatch]:
                shard, first = np.array(codes, np.int32), np.array(starts)
                for part in parts:
                    index: TestIndex = part.value
                    known = np.fromiter(map(index.vocab.get, number, repeat(0)), np.int32, len(number))
                    t, c, n = index.search(np.concatenate((np.zeros(1, np.int32), known))[shard])
                    if len(t):
                        t, c, n = index.best(t, c, n, np.searchsorted(first, c, "right"))
                        doc, owner = np.searchsorted(first, c, "right") - 1, np.searchsorted(index.begins, t, "right") - 1
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(index.items).take(pa.array(owner)), ids.take(pa.array(np.array(rows)[doc])), pa.array(t - index.begins[owner]), pa.array(c - first[doc]), pa.array(n.astype(np.int64))], names
                        )
                    if len(parts) > 1:  # a worker holds one part at a time
                        part.__dict__.pop("_value", None)
                number.clear(), rows.clear(), starts.clear()
                del codes[:]

            for i, text in enumerate(batch.column(1)):
                w = words(text.as_py())
                if len(w) < min_words:
                    continue
                if codes and len(codes) + len(w) > SHARD:
                    yield from flush()
                    number.default_factory = count(1).__next__
                rows.append(i), starts.append(len(codes))
                codes.extend(map(number.__getitem__, w))
                codes.append(0)
            if rows:
                yield from flush()

    return search


def find_leaks(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", min_words: int = 12) -> DataFrame:
    """``item_id, doc_id, item_word, doc_word, n_words``: of each test passage and document that share at least ``min_words`` words in a row, the longest such run.

    ``item_word`` and ``doc_word`` are the run's first words, counted from 0; of equally long runs the first of the passage is named.

    Defined cases: null and short texts or passages match nothing; rows with a null id are left out; repeated rows
    report repeatedly; test items that overlap each other are all reported; an empty side gives no rows; other columns are not looked
    at. A document of more than two shards is searched in pieces that overlap. The corpus is read once, however large the test side is.
    """
    texts = docs.select(F.col(id_col).alias("doc"), F.make_valid_utf8(F.col(text_col)).alias("text")).filter("doc is not null and text is not null")
    items = tests.select(F.col(item_col).alias("item"), F.col(passage_col).alias("passage")).filter("item is not null and passage is not null")
    schema = T.StructType(
        [T.StructField(item_col, items.schema["item"].dataType), T.StructField(id_col, texts.schema["doc"].dataType)] + [T.StructField(c, T.LongType()) for c in ("item_word", "doc_word", "n_words")]
    )
    context = docs.sparkSession.sparkContext
    # the driver holds one part at a time too
    parts = [context.broadcast(index) for index in index_parts(((r["item"], r["passage"]) for r in items.toLocalIterator()), min_words) if index.items]
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    return spread(texts).mapInArrow(_searcher(parts, schema.names, min_words), schema)


def drop_leaked(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents without a leak; rows with a null id stay."""
    return docs.join(leaks.select(id_col).distinct(), id_col, "left_anti")
