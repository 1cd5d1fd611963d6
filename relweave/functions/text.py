"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters, numbers and underscores, whatever the script.
TOKEN = r"[\p{L}\p{N}_]+"


def norm(c: Column) -> Column:
    """Lower case, no white space at the ends, one blank for each inner run; white space in the Unicode sense."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def norm_value(value: object) -> str:
    """`norm` of a literal."""
    return " ".join(str(value).lower().split())


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0)


def token_estimate(c: Column) -> Column:
    """Four characters a token, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def truncate_tokens(c: Column, most: int) -> Column:
    return F.substring(c, 1, 4 * most)


def similarity_from_distance(d: Column) -> Column:
    """1 / (1 + d); a negative distance passes as it is."""
    return F.when(d >= 0, 1 / (1 + d)).otherwise(d)


def epoch_seconds(c: Column) -> Column:
    """Seconds since 1970 of an ISO-8601 time (``Z`` allowed, UTC where no zone is named) or of a number in text; else null."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(c)) / 1e6, c.try_cast("double"))


def answer_check(answer: Column, expected: Column, pattern: Column, part: Column) -> Column:
    """Struct ``mode, expected, passed``: exact beats regex beats contains; without an answer the mode is ``none``; null without any expectation."""

    def result(mode: str, what: Column, passed: Column) -> Column:
        return F.struct(F.lit(mode).alias("mode"), what.cast("string").alias("expected"), passed.alias("passed"))

    blanks = r"(?U)^\s+|\s+$"
    exact = F.regexp_replace(answer, blanks, "") == F.regexp_replace(expected, blanks, "")
    return (
        F.when(F.coalesce(expected, pattern, part).isNull(), None)
        .when(answer.isNull(), result("none", F.coalesce(expected, pattern, part), F.lit(False)))
        .when(expected.isNotNull(), result("exact", expected, exact))
        .when(pattern.isNotNull(), result("regex", pattern, F.regexp_like(answer, pattern)))
        .otherwise(result("contains", part, F.contains(answer, part)))
    )


def case_status(error: Column, passed: Column, plan_only: Column) -> Column:
    """Status of a case: an error first, then the check's outcome, then how it ran."""
    return F.when(error.isNotNull() & (error != ""), "error").when(passed, "ok").when(~passed, "mismatch").when(plan_only, "plan_only").otherwise("unchecked")
