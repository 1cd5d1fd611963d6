"""Joins in which a few keys hold most rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least number of equal parts that rows are thought cut into (the session's shuffle partitions if these are more); rows that no join need be cut for.
PARTS, FEW = 256, 50_000


@dataclass(frozen=True)
class Hot:
    """Hashes of the keys that hold many rows, by the number of pieces they are cut into (powers of two, so there are few such numbers).

    Another key with the hash of a hot one is cut too, on both sides alike, which changes nothing in the result.
    """

    hashes: dict[int, list[int]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: DataFrame, keys: list[str]) -> Hot | None:
        """``rows``: keys and ``pieces``; fewer rows than there are parts."""
        found: dict[int, list[int]] = {}
        for r in rows.select(F.xxhash64(*keys).alias("h"), "pieces").collect():
            found.setdefault(1 << max(0, r["pieces"] - 1).bit_length(), []).append(r["h"])
        return cls(found) if found else None

    def pieces(self, keys: list[Column]) -> Column:
        h, out = F.xxhash64(*keys), F
        for n, hashes in self.hashes.items():
            out = out.when(h.isin(hashes), n)
        return out.otherwise(1)


def hot_pieces(counts: DataFrame, keys: list[str], n: str = "n", total: int | None = None, most: int | None = None) -> Hot | None:
    """The keys that hold more than one part of the rows, with a piece for each part that they hold; none where no key is hot.

    There are fewer hot keys than parts, whatever the data. ``counts``: rows ``n`` by ``keys``, not necessarily of all keys;
    ``total``: the rows of all keys, else the sum of ``n``; ``most``: the greatest ``n`` if known, which may tell at once that no key is hot.
    """
    if most is not None and most <= FEW:
        return None
    return Hot.of(hot_rows(counts, keys, n, total), keys)


def hot_rows(counts: DataFrame, keys: list[str], n: str, total: int | None = None) -> DataFrame:
    """``keys, pieces`` of `hot_pieces` as a frame."""
    if total is None:
        total = counts.agg(F.sum(n)).first()[0] or 0
    part = max(FEW, total // max(PARTS, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return counts.filter(F.col(n) > part).select(*keys, F.ceil(F.col(n) / part).cast("int").alias("pieces"))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: Hot | None, spread_by: list[str], how: str = "inner", hint: str | None = None) -> DataFrame:
    """``left JOIN right USING (keys)``; the rows of ``left`` with a hot key go to as many partitions as the key has pieces.

    ``spread_by``: columns of ``left`` that tell a key's rows apart. The rows of ``right`` with a hot key are repeated once a piece; it has few of
    them. Hot keys must have the same types on both sides (`TypeError`), or their hashes would differ.
    """
    if hot is None:
        return left.join(right.hint(hint) if hint else right, keys, how)
    if bad := [k for k in keys if left.schema[k].dataType != right.schema[k].dataType]:
        raise TypeError(f"the keys {bad} have different types on the two sides")
    pieces, salt = hot.pieces([F.col(k) for k in keys]), "__salt"
    a = left.withColumn(salt, F.pmod(F.xxhash64(*spread_by), pieces).cast("int"))
    b = right.withColumn(salt, F.explode(F.sequence(F.lit(0), pieces - 1)))
    return a.join(b.hint(hint) if hint else b, [*keys, salt], how).drop(salt)
