"""References to records that do not exist: merge of reference and parent streams over validity intervals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.plans.skew import Hot, hot_rows, salted_join

#: Pieces that a key's references are cut into if it is only said to be hot, not how hot.
SALTS = 16


def validity(parents: DataFrame, deleted: DataFrame) -> DataFrame:
    """Intervals of parent keys: ``parent, key, valid_from, valid_to, deleted_at``.

    ``parents`` (parent, key, loaded_at, and last_at where rows are put together already) and ``deleted`` (parent, key, deleted_at) may repeat
    keys. ``valid_from`` is the first arrival (null: the parent table never had the key), ``deleted_at`` the last deletion. ``valid_to`` is
    the last deletion if nothing arrived after it, else null: a key that came again is valid from its first arrival on.
    """
    came, gone = parents.schema["loaded_at"].dataType, deleted.schema["deleted_at"].dataType
    last = "last_at" if "last_at" in parents.columns else "loaded_at"
    both = parents.select("parent", "key", F.col("loaded_at").alias("valid_from"), F.col(last).alias("last"), F.lit(None).cast(gone).alias("deleted_at")).unionByName(
        deleted.select("parent", "key", F.lit(None).cast(came).alias("valid_from"), F.lit(None).cast(came).alias("last"), "deleted_at")
    )
    one = both.filter("parent is not null and key is not null").groupBy("parent", "key").agg(F.min("valid_from").alias("valid_from"), F.max("last").alias("last"), F.max("deleted_at").alias("deleted_at"))
    return one.select("parent", "key", "valid_from", F.when(F.col("deleted_at") >= F.col("last"), F.col("deleted_at")).alias("valid_to"), "deleted_at")


def hot_references(refs: DataFrame) -> dict[str, dict]:
    """By parent, the keys that hold many of the references, with pieces in proportion to their number."""
    counts = refs.filter("key is not null").groupBy("parent", "key").agg(F.count(F.lit(1)).alias("n"))
    out: dict[str, dict] = {}
    for r in hot_rows(counts, ["parent", "key"], "n", refs.count()).collect():  # fewer than there are parts
        out.setdefault(r["parent"], {})[r["key"]] = r["pieces"]
    return out


def find_orphans(refs: DataFrame, intervals: DataFrame, hot: Mapping[str, list | Mapping] | None = None, ended: bool = False) -> DataFrame:
    """Orphan references: ``field, period, kind, row_id``.

    ``refs``: ``field, parent, row_id, key, seen_at``, one row a reference. ``intervals``: of `validity`. Both sides are
    partitioned and sorted by (parent, key) and merged in one linear pass (a sort-merge join).
    ``hot`` names, by parent, keys that hold many references, with the number of pieces (of `hot_references`; ``SALTS`` each of a list):
    their references are spread over as many partitions, with one copy of the parent's interval each.

    Kinds: ``late`` (the reference was made before the parent's interval begins), ``deleted`` and ``missing``. With ``ended`` a reference that was made
    when the interval had ended (at the time of the deletion or later) is ``deleted`` too: ``valid_from <= seen_at < valid_to`` decides. Without, a parent
    that its table has is there from its arrival on, whatever the log says. A key that the table never had is ``deleted`` if the
    log names it, else ``missing``.

    Null keys refer to nothing and are left out. A null ``seen_at`` can't be before or after anything, so it is never late nor
    too late; its period is null. A parent whose arrival times are all null counts as absent. Empty parents make every
    reference missing or deleted; empty references give no rows.
    """
    pieces = {p: ks if isinstance(ks, Mapping) else dict.fromkeys(ks, SALTS) for p, ks in (hot or {}).items()}
    rows = [(p, k, n) for p, ks in pieces.items() for k, n in ks.items() if k is not None]
    spark = refs.sparkSession
    few = Hot.of(spark.createDataFrame(rows, refs.select("parent", "key", F.lit(0).alias("pieces")).schema), ["parent", "key"]) if rows else None
    left = refs.filter("key is not null").select("field", "parent", "row_id", "key", "seen_at")
    met = salted_join(left, intervals, ["parent", "key"], few, ["row_id"], "left", hint="merge")
    gone = F.col("valid_to") <= F.col("seen_at") if ended else F.lit(False)
    kind = (
        F.when(F.col("valid_from") > F.col("seen_at"), "late")
        .when(F.col("valid_from").isNotNull() & gone, "deleted")
        .when(F.col("valid_from").isNotNull(), None)
        .when(F.col("deleted_at").isNotNull(), "deleted")
        .otherwise("missing")
    )
    return met.withColumn("kind", kind).filter("kind is not null").select("field", F.date_format("seen_at", "yyyy-MM").alias("period"), "kind", "row_id")
