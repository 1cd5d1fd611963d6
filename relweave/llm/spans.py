"""Long exact spans shared between records: compaction of a de Bruijn graph partitioned by minimizers.

The graph's edges are the windows of ``k`` consecutive code points of every text. Writing all of them out would
take k times the text, so each text is cut into runs of consecutive windows that share a minimizer (the g-gram with
the least hash inside the window, the leftmost of equals). The minimizer depends on nothing but the
window, so equal windows always fall into the same bucket, at the same distance from the minimizer.

* A bucket whose minimizer stands in one document holds no shared window and is dropped.
* A run that is the same, whole, in two documents is a repeated path without branches: all its windows are shared. Where every occurrence
  of a repeated run has the same neighbour, and the neighbour has no other on that side, the two are joined; maximal
  chains of such runs are the compacted paths. A path is named by its first run and has one occurrence a copy.
* Where one bucket holds different runs the path branches. Only there the distinct runs, once each, are
  split into their windows, and equal windows of different runs are found by a join.

Runs, neighbours and windows are matched by 64-bit and 128-bit fingerprints; what these say is then verified against the source. Every
occurrence of every repeated path is cut from its text by its coordinates, and all cuts of one path must be the
same text, character for character; so must all windows that are taken as equal. If they are not, the attempt is given up and
made again with other fingerprints. Only the documents that hold such paths or runs have their text moved.

Shared windows go back to the source coordinates of every run that holds them, and each document's windows are
glued into maximal spans. No pairs of documents are made anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.plans.materialize import materialize, materialize_counts
from relweave.plans.partitioning import spread
from relweave.plans.skew import Hot, hot_pieces, salted_join

#: Code points that are hashed at a time (longer texts go in pieces that overlap by k - 1), of a block that cuts are made from, and windows of a piece of a path that is verified as one.
CHUNK, BLOCK, PIECE = 1_000_000, 65_536, 8_192
#: Seeds of the fingerprints and the bits that are kept of each; the next is tried where texts with one fingerprint differ.
ATTEMPTS = ((0, -1), (1, -1), (2, -1))
#: Bits of the map of documents whose text is needed; it has at most a row for 64 of them.
MAP_BITS = 1 << 25
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_KEY = ["anchor", "hi", "lo", "n"]


class Clash(Exception):
    """Different texts have one fingerprint."""


def gram_hashes(codes: np.ndarray, g: int) -> np.ndarray:
    """Mixed 64-bit hashes of all g-grams, in O(n log g) vector steps."""
    with np.errstate(over="ignore"):
        unit = (codes.astype(np.uint64) + np.uint64(1)) * _MIX[1]
        unit ^= unit >> np.uint64(31)
        power, cur, done, out = _MIX[0], unit, 0, None
        size = 1
        while True:
            if g & size:  # append a block of this size after what is covered so far
                if out is None:
                    out = cur
                else:
                    n = len(codes) - done - size + 1
                    out = out[:n] * power + cur[done : done + n]
                done += size
            if done == g:
                break
            cur = cur[:-size] * power + cur[size:]
            power = power * power
            size *= 2
        out = out[: len(codes) - g + 1]
        out = (out ^ (out >> np.uint64(32))) * _MIX[2]
        return out ^ (out >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, cur = 1, values
    while size * 2 <= width:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    return np.minimum(cur[: len(cur) - (width - size)], cur[width - size :]) if size < width else cur


def _runs(texts: list[str], k: int, g: int, seed: int = 0, mask: int = -1) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer over pieces of text: piece, first window, number of windows, minimizer, fingerprints."""
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    raw = memoryview(joined.encode("utf-8", "surrogatepass"))
    at_byte = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), out=at_byte[1:])
    lens = np.array([len(t) for t in texts])
    ends = np.cumsum(lens)
    hashes = gram_hashes(codes, g)
    low = np.uint64(0xFFFFFF)
    least = sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), k - g + 1)
    piece = np.repeat(np.arange(len(texts)), lens)[: len(least)]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(least))
    of = piece[first]
    stop = np.minimum(stop, ends[of] - k + 1)
    keep = stop > first
    first, stop, of = first[keep], stop[keep], of[keep]
    anchor = hashes[(least[first] & low).astype(np.int64)]
    a, b = at_byte[first].tolist(), at_byte[stop + k - 1].tolist()
    h3, h64 = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest
    hi = np.fromiter((h3(raw[x:y], seed) for x, y in zip(a, b)), np.uint64, len(a))
    lo = np.fromiter((h64(raw[x:y], seed) for x, y in zip(a, b)), np.uint64, len(a))
    return of, first - (ends - lens)[of], stop - first, anchor.view(np.int64), hi.view(np.int64) & mask, lo.view(np.int64) & mask


def _cutter(k: int, g: int, seed: int, mask: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids = batch.column(0), batch.column(1)
            texts: list[str] = []
            rows: list[int] = []
            base: list[int] = []

            def flush() -> pa.RecordBatch:
                of, first, n, anchor, hi, lo = _runs(texts, k, g, seed, mask)
                at = pa.array(np.array(rows)[of])
                out = pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(hi), pa.array(lo), ids.take(at), rids.take(at), pa.array((first + np.array(base)[of]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["anchor", "hi", "lo", "doc", "rid", "first", "n"],
                )
                texts.clear(), rows.clear(), base.clear()
                return out

            size = 0
            for i, text in enumerate(batch.column(2)):
                text = text.as_py()
                for start in range(0, len(text) - k + 1, CHUNK):
                    part = text[start : start + CHUNK + k - 1]
                    if size + len(part) > 4 * CHUNK:
                        yield flush()
                        size = 0
                    texts.append(part), rows.append(i), base.append(start)
                    size += len(part)
            if texts:
                yield flush()

    return cut


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 100, g: int | None = None) -> DataFrame:
    """``doc_id, span_start, span_end``: maximal stretches covered by windows of ``k`` code points that stand in another document too.

    Code points from 0, end exclusive; overlapping or touching windows form one stretch. ``g`` (default k / 2): length of
    the minimizers; it changes the work, not the result.

    Defined cases: null, empty and shorter texts have no windows; rows with a null id can't be named and are left
    out; rows that repeat an id are one document (they never share with each other, their spans are merged);
    a repetition inside one document alone doesn't count; other columns are not looked at. `Clash` if fingerprints of
    different texts are the same in every one of ``ATTEMPTS``.
    """
    g = g or max(1, k // 2)
    if not 1 <= g <= k:
        raise ValueError("g must be between 1 and k")
    texts = docs.select(F.col(id_col).alias("doc"), F.make_valid_utf8(F.col(text_col)).alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") >= k))
    # rows that repeat an id are told apart by their text
    texts = texts.select("doc", F.xxhash64("text").alias("rid"), "text")
    for seed, mask in ATTEMPTS:
        try:
            found = _shared(texts, k, g, seed, mask)
            break
        except Clash as e:
            clash = e
    else:
        raise clash
    by_doc = Window.partitionBy("doc").orderBy("s", "e")
    before = F.max("e").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    glued = found.withColumn("new", F.when(before >= F.col("s"), 0).otherwise(1)).withColumn("span", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return glued.groupBy("doc", "span").agg(F.min("s").cast("long").alias("span_start"), F.max("e").cast("long").alias("span_end")).select(F.col("doc").alias(id_col), "span_start", "span_end")


def _shared(texts: DataFrame, k: int, g: int, seed: int, mask: int) -> DataFrame:
    """``doc, s, e``: stretches of shared windows, not yet glued."""
    kind = texts.schema["doc"].dataType
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "hi", "lo")] + [T.StructField("doc", kind), T.StructField("rid", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("n", T.IntegerType())])
    runs = materialize(spread(texts).mapInArrow(_cutter(k, g, seed, mask), schema), "runs")

    ends = [F.min("doc").alias("a"), F.max("doc").alias("b")]
    anchors, *sizes = materialize_counts(runs.groupBy("anchor").agg(*ends, F.count(F.lit(1)).alias("c")).filter("a < b").select("anchor", "c"), "anchors", "c")
    near = materialize(salted_join(runs, anchors.select("anchor"), ["anchor"], hot_pieces(anchors, ["anchor"], "c", *sizes), ["doc", "first"], "left_semi"), "near")
    edges, *sizes = materialize_counts(near.groupBy(_KEY).agg(*ends, F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "rid", "first")).alias("at")), "edges", "c")
    hot = hot_pieces(edges, _KEY, "c", *sizes)

    paths = _paths(near, edges.filter("a < b"), hot, k)
    forks = edges.groupBy("anchor").agg(F.count(F.lit(1)).alias("ways")).filter("ways > 1").select("anchor")
    branches = edges.join(forks, "anchor", "left_semi").select("at.doc", "at.rid", F.col("at.first").alias("s"), F.lit(-1).alias("piece"), F.col("n").alias("w"), *_KEY, "a", "b")

    def pieces(df: DataFrame, windows: Column) -> DataFrame:
        """Paths in pieces of ``w`` windows, so that no cut is longer than a piece."""
        number = F.explode(F.sequence(F.lit(0), F.floor((windows - 1) / PIECE).cast("int")))
        each = df.select("doc", "rid", "s", number.alias("piece"), windows.alias("all"), *_KEY)
        return each.select("doc", "rid", (F.col("s") + F.col("piece") * PIECE).alias("s"), "piece", F.least(F.lit(PIECE), F.col("all") - F.col("piece") * PIECE).alias("w"), *_KEY, *[F.lit(None).cast(kind).alias(c) for c in "ab"])

    # the first of an occurrence's repetitions stands for all, as the text of them all has the path's length as its period
    again = pieces(paths.filter("times > 1"), F.col("n") * F.col("times")).withColumn("piece", F.lit(-2))
    cuts = _cut(texts, pieces(paths, F.col("n")).unionByName(again).unionByName(branches), k)

    def print_of(w: str) -> list[Column]:
        return [F.xxhash64(F.lit(seed + i), F.lit(k), w).bitwiseAND(F.lit(mask)).alias(c) for i, c in enumerate("xy")]

    # every run has a bounded length (at most k - g + 1 windows), so a branch splits into a bounded number of windows
    split = cuts.filter("piece = -1").select(*_KEY, "a", "b", "cut", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).withColumn("w", F.substring("cut", F.col("i") + 1, F.lit(k)))
    windows = materialize(split.select(*_KEY, "a", "b", "i", *print_of("w"), "w"), "windows")
    twice, *sizes = materialize_counts(windows.groupBy("x", "y").agg(F.min("a").alias("a2"), F.max("b").alias("b2"), F.count(F.lit(1)).alias("c")).filter("a2 < b2").select("x", "y", "c"), "twice", "c")
    busy = hot_pieces(twice, ["x", "y"], "c", *sizes)
    equal = salted_join(windows.select("x", "y", "w", "anchor", "i"), twice.select("x", "y"), ["x", "y"], busy, ["anchor", "i"], "left_semi")
    texts_of = lambda c: [F.min(c).alias("least"), F.max(c).alias("most"), F.count_if(F.col(c).isNull()).alias("lost")]
    verified = cuts.filter("piece >= 0").groupBy(*_KEY, "piece").agg(*texts_of("cut")).select("least", "most", "lost").unionByName(equal.groupBy("x", "y").agg(*texts_of("w")).select("least", "most", "lost"))
    period = [F.expr("substring(cut, 1, length(cut) - n)").alias("least"), F.expr("substring(cut, n + 1)").alias("most"), F.col("cut").isNull().cast("long").alias("lost")]
    verified = verified.unionByName(cuts.filter("piece = -2").select(*period))
    if verified.agg(F.count_if(F.expr("lost > 0 or least <> most"))).first()[0]:  # one pass over all groups at once
        raise Clash("paths or windows with one fingerprint have different texts")
    part = salted_join(windows.filter("a = b").drop("w"), twice.select("x", "y"), ["x", "y"], busy, ["anchor", "i"], "left_semi").select(*_KEY, "i").distinct()
    order = Window.partitionBy(_KEY).orderBy("i")  # at most k - g + 1 rows each
    part = part.withColumn("island", F.col("i") - F.row_number().over(order)).groupBy(*_KEY, "island").agg(F.min("i").alias("i"), F.max("i").alias("j")).drop("island")
    inside = salted_join(near, part, _KEY, hot, ["doc", "first"])
    return paths.select("doc", "s", (F.col("s") + F.col("n") * F.col("times") - 1 + k).alias("e")).unionByName(inside.select("doc", (F.col("first") + F.col("i")).alias("s"), (F.col("first") + F.col("j") + k).alias("e")))


def _paths(near: DataFrame, repeated: DataFrame, hot: Hot | None, k: int) -> DataFrame:
    """``doc, rid, s, anchor, hi, lo, n, times``: the occurrences of compacted paths, named by their first run; ``n`` windows from ``s`` on, ``times`` times in a row.

    A repeated run begins a path unless all its occurrences follow one and the same repeated run which nothing else follows. Going along
    a document, each run that begins none is joined to the one before; so all copies of a path are cut alike. Short paths that follow themselves
    (a character repeated a million times is one) are put together.
    """
    own = salted_join(near, repeated.select(_KEY), _KEY, hot, ["doc", "first"], "left_semi").select("doc", "rid", "first", *_KEY)
    along = Window.partitionBy("doc", "rid").orderBy("first")
    name = F.xxhash64(*_KEY)
    # rows that repeat an id with the same text are one; the partitioning serves the window as well
    own = own.repartition("doc", "rid").dropDuplicates(["doc", "rid", "first"])
    links = own.select(
        "doc", "rid", "first", *_KEY,
        F.when(F.lag(F.col("first") + F.col("n")).over(along) == F.col("first"), F.lag(name).over(along)).alias("before"),
        F.when(F.lead("first").over(along) == F.col("first") + F.col("n"), F.lead(name).over(along)).alias("after"),
    )
    same = lambda c: F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.min(c)).alias(c)
    nodes = links.groupBy(_KEY).agg(same("before"), same("after")).withColumn("name", name)
    inner = nodes.select(F.col("name").alias("before"), F.col("after").alias("name")).filter("name is not null")
    joined = nodes.select("name", "before", *_KEY).filter("before is not null").join(inner, ["name", "before"], "left_semi").select(*_KEY, F.lit(False).alias("begins"))
    marked = salted_join(links.drop("before", "after"), joined, _KEY, hot, ["doc", "first"], "left")
    marked = marked.repartition("doc", "rid").withColumn("path", F.count_if(F.coalesce("begins", F.lit(True))).over(along))
    one = marked.groupBy("doc", "rid", "path").agg(F.min("first").alias("s"), F.sum("n").cast("int").alias("n"), F.min_by(F.struct("anchor", "hi", "lo"), "first").alias("head"))
    on = Window.partitionBy("doc", "rid").orderBy("s")
    follows = (F.col("n") < k) & (F.lag(F.struct("head", F.col("s") + F.col("n"), "n")).over(on) == F.struct("head", "s", "n"))
    one = one.withColumn("row", F.count_if(~F.coalesce(follows, F.lit(False))).over(on)).groupBy("doc", "rid", "row", "head", "n").agg(F.min("s").alias("s"), F.count(F.lit(1)).cast("int").alias("times"))
    return materialize(one.select("doc", "rid", "s", "head.anchor", "head.hi", "head.lo", "n", "times"), "paths")


def _cut(texts: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """``places`` (``doc, rid, s, w, ...``) with their text ``cut``: w + k - 1 code points from ``s`` on, w at most a piece.

    Only the texts of documents that have places are moved. Which these are is told by a bit map of hashed ids: a table of at most
    ``MAP_BITS / 64`` rows whatever the corpus, so it can be broadcast; an id that shares its bit moves a text in vain.
    """
    bit = F.pmod(F.xxhash64("doc"), F.lit(MAP_BITS))
    in_word = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    wanted = places.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(in_word).alias("bits"))
    own = texts.withColumn("bit", bit).withColumn("word", F.floor(F.col("bit") / 64)).join(F.broadcast(wanted), "word").filter(F.col("bits").bitwiseAND(in_word) != 0)
    # a long text goes in blocks, since finding a position takes time in proportion to it
    last = F.floor((F.length("text") - 1) / BLOCK).cast("int")
    blocks = own.select("doc", "rid", "text", F.explode(F.sequence(F.lit(0), last)).alias("block")).select("doc", "rid", "block", F.expr(f"substring(text, block * {BLOCK} + 1, {BLOCK + PIECE + k})").alias("part"))
    met = places.withColumn("block", F.floor(F.col("s") / BLOCK).cast("int")).join(blocks, ["doc", "rid", "block"], "left")
    cut = F.expr(f"substring(part, s - block * {BLOCK} + 1, w + {k - 1})")
    return materialize(met.select(*places.columns, F.when(F.length(cut) == F.col("w") + k - 1, cut).alias("cut")), "cuts")


def shared_amounts(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, shared_chars, share`` of every document, 0 where nothing is shared; the share of a null or empty text is 0."""
    total = spans.groupBy(F.col(id_col).alias("__d")).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("__s"))
    own = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.length(text_col), F.lit(0)).alias("__n"))
    both = own.join(total, own["__id"] == total["__d"], "left")
    shared = F.coalesce("__s", F.lit(0))
    return both.select(F.col("__id").alias(id_col), shared.alias("shared_chars"), F.when(F.col("__n") > 0, shared / F.col("__n")).otherwise(0.0).alias("share"))
