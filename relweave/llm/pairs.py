"""Items that appear together: pair counts by heavy-light decomposition.

* Heavy items (those that hold a ``HEAVY``-th of the rows or more, so there are at most ``HEAVY``, however large the table) are the columns of dense
  bit matrices, one a run of baskets; a pair's count is the popcount of the AND of two columns.
* Rare pairs are counted by hash, basket by basket. Items too rare to reach ``min_count`` are dropped first, and a large
  basket is cut into blocks of items whose pairs of blocks are separate units of work.
* Mixed pairs: each rare item's row probes the list of heavy items of its basket.

The largest baskets (fewer than ``min_count`` of them) make no pairs of rare items at all: a pair that reaches
``min_count`` must occur in other baskets too, so these pairs only have the giants' membership added to their count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.plans.materialize import materialize

#: Parts of all rows of which a heavy item holds one at least; items of a block of a large basket; least size of a giant basket; bits of one matrix, and its most baskets.
HEAVY, BLOCK, GIANT, BITS, MATRIX = 1024, 128, 512, 1 << 24, 65_536


def _popcounts(width: int):
    """Rows (basket, heavy item number) sorted by basket in; counts of pairs of numbers out, one set a matrix."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = min(MATRIX, max(64, BITS // width // 64 * 64))

        def pairs(bits: np.ndarray) -> pa.RecordBatch:
            packed = np.packbits(bits, axis=1)
            out = [np.bitwise_count(packed[i] & packed[i + 1 :]).sum(axis=1, dtype=np.int64) for i in range(width)]
            a, b = np.triu_indices(width, 1)
            n = np.concatenate(out)
            some = n > 0
            return pa.RecordBatch.from_arrays([pa.array(a[some].astype(np.int32)), pa.array(b[some].astype(np.int32)), pa.array(n[some])], ["a", "b", "n"])

        bits, row, last = np.zeros((width, size), bool), -1, None
        for batch in batches:
            basket, item = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            if not len(basket):
                continue
            new = np.concatenate(([row < 0 or basket[0] != last], basket[1:] != basket[:-1]))
            rows, last = row + np.cumsum(new), basket[-1]
            while rows[-1] >= size:
                now = rows < size
                bits[item[now], rows[now]] = True
                yield pairs(bits)
                bits[:] = False
                rows, item = rows[~now] - size, item[~now]
            bits[item, rows] = True
            row = rows[-1]
        if row >= 0:
            yield pairs(bits)

    return count


def cooccurring(df: DataFrame, basket: str, item: str, min_count: int = 2, heavy: int = HEAVY) -> DataFrame:
    """``item_a, item_b, n_ab, n_a, n_b, n_baskets, lift`` of every pair (a < b) that occurs together in at least ``min_count`` baskets.

    An item counts once a basket. ``lift`` is ``n_ab * n_baskets / (n_a * n_b)``.

    Defined cases: rows with a null basket or item don't take part (nor does such a basket count); repeated rows count once;
    a basket of one item has no pairs but counts as a basket; an empty table gives no rows; other columns are not looked at.
    """
    spark = df.sparkSession
    base = materialize(df.select(F.col(basket).alias("k"), F.col(item).alias("i")).filter("k is not null and i is not null").distinct(), "baskets")
    n_baskets = base.select("k").distinct().count()
    counts = materialize(base.groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count), "counts")
    least = max(1, -(-base.count() // max(1, heavy)))
    top = [r["i"] for r in counts.filter(F.col("n") >= least).collect()] if heavy else []  # at most `heavy` items hold so many rows each
    number = spark.createDataFrame([(x, j) for j, x in enumerate(sorted(top))], T.StructType([T.StructField("i", base.schema["i"].dataType), T.StructField("j", T.IntegerType())]))
    thick = base.filter(F.col("i").isin(top)).join(F.broadcast(number), "i").select("k", "j")  # at most `heavy` rows are broadcast
    thin = materialize(base.filter(~F.col("i").isin(top)).join(counts.select("i"), "i", "left_semi"), "rare")

    sizes = thin.groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    giants = [r["k"] for r in sizes.filter(F.col("m") >= GIANT).orderBy(F.desc("m"), "k").limit(max(0, min(min_count - 1, 60))).collect()]

    hh = thick.repartition("k").sortWithinPartitions("k").mapInArrow(_popcounts(max(1, len(top))), "a int, b int, n long")
    hh = hh.groupBy("a", "b").agg(F.sum("n").alias("n"))
    names = [F.broadcast(number.select(F.col("j").alias(c), F.col("i").alias(f"i{c}"))) for c in ("a", "b")]
    hh = hh.join(names[0], "a").join(names[1], "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"), "n")

    lists = thick.groupBy("k").agg(F.collect_list("j").alias("js"))  # at most `heavy` numbers a basket
    hl = thin.join(lists, "k").select("i", F.explode("js").alias("j")).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    hl = hl.join(F.broadcast(number.withColumnRenamed("i", "h")), "j").select(F.least("i", "h").alias("a"), F.greatest("i", "h").alias("b"), "n")

    usual = thin.filter(~F.col("k").isin(giants)) if giants else thin
    blocks = sizes.filter("m > 1").select("k", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    cells = usual.join(blocks, "k").withColumn("x", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))
    cells = cells.select("k", "i", "x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    cells = cells.select("k", "i", "x", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    other = cells.select(F.col("k").alias("k2"), F.col("i").alias("i2"), F.col("x").alias("x2"), F.col("u").alias("u2"), F.col("v").alias("v2"))
    met = cells.join(other, (cells.k == other.k2) & (cells.u == other.u2) & (cells.v == other.v2) & (cells.i < other.i2) & ((F.col("u") == F.col("v")) | (F.col("x") != F.col("x2"))))
    ll = met.groupBy(F.col("i").alias("a"), F.col("i2").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    if giants:
        bit = F.element_at(F.create_map(*[F.lit(x) for j, g in enumerate(giants) for x in (g, 1 << j)]), F.col("k")).cast("long")
        member = materialize(thin.filter(F.col("k").isin(giants)).groupBy("i").agg(F.bit_or(bit).alias("m")), "giants")
        ll = ll.filter(F.col("n") >= min_count - len(giants))
        for c in ("a", "b"):
            ll = ll.join(member.select(F.col("i").alias(c), F.col("m").alias(f"m{c}")), c, "left")
        ll = ll.select("a", "b", (F.col("n") + F.coalesce(F.bit_count(F.col("ma").bitwiseAND(F.col("mb"))), F.lit(0))).alias("n"))

    pairs = hh.unionByName(hl).unionByName(ll).filter(F.col("n") >= min_count)
    for c in ("a", "b"):
        pairs = pairs.join(counts.select(F.col("i").alias(c), F.col("n").alias(f"n_{c}")), c)
    lift = F.col("n").cast("double") * n_baskets / (F.col("n_a").cast("double") * F.col("n_b"))
    return pairs.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), F.col("n").alias("n_ab"), "n_a", "n_b", F.lit(n_baskets).cast("long").alias("n_baskets"), lift.alias("lift"))
