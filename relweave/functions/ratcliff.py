"""Ratcliff-Obershelp similarity, over the distinct values of a column only."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least similarity and least length of a value that counts as a near match.
RATIO, LEAST = 0.85, 3


@F.pandas_udf(T.DoubleType())
def ratio(value: pd.Series, needle: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(value, needle)], dtype="float64")


def bound(value: Column, needle: str) -> Column:
    """An upper bound of the similarity by lengths and letter counts, worked out in the JVM: a match can't use a letter more often than both texts have it."""
    common = [F.least(F.lit(n), F.length(value) - F.length(F.replace(value, F.lit(c), F.lit("")))) for c, n in Counter(needle).items()]
    return 2.0 * reduce(lambda a, b: a + b, common, F.lit(0)) / (F.length(value) + F.lit(len(needle)))


def near_values(df: DataFrame, column: str, needles: list[str]) -> DataFrame:
    """Distinct values (``value``) of a normalised column that are near one of the needles (each at least ``LEAST`` long).

    Only values that the bound lets pass reach Python, in one pass for all needles.
    """
    own = df.select(F.col(column).alias("value")).filter(F.length("value") >= LEAST)

    @F.pandas_udf(T.BooleanType())
    def near(values: pd.Series) -> pd.Series:
        matchers = [SequenceMatcher(None, "", n) for n in needles]  # what is known of the needle is worked out once

        def one(value: str) -> bool:
            for m in matchers:
                m.set_seq1(value)
                if m.ratio() >= RATIO:
                    return True
            return False

        return values.map(one).astype(bool)

    may = reduce(lambda a, b: a | b, [(F.length("value") * (2 - RATIO) >= RATIO * len(n)) & (F.length("value") * RATIO <= (2 - RATIO) * len(n)) & (bound(F.col("value"), n) >= RATIO) for n in needles], F.lit(False))
    return own.filter(may).distinct().filter(near("value"))
