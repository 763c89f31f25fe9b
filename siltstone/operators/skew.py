"""Joins that hold when one key owns a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it owns more than this share of the rows, so there are at
# most 1 / HOT_SHARE hot keys: the side broadcast for them has a proven bound.
HOT_SHARE = 1e-4
HOT_ROWS = 1_000_000


def hot_threshold(total_rows: int) -> int:
    return max(HOT_ROWS, int(total_rows * HOT_SHARE))


def lookup_join(
    facts: DataFrame, lookup: DataFrame, key: str | list[str], rows: str, total_rows: int, how: str = "inner"
) -> DataFrame:
    """Join of many facts per key with one lookup row per key, inner or left.

    ``lookup`` knows the number of facts of each key in column ``rows``.  The
    few hot keys are broadcast, so their facts stay where they are and are
    never gathered in one task; all other keys meet by a shuffle.
    """
    limit = hot_threshold(total_rows)
    if total_rows <= limit:
        return facts.join(lookup, key, how)
    hot = F.broadcast(lookup.where(F.col(rows) > limit))
    cold = lookup.where(F.col(rows) <= limit)
    if how == "inner":
        return facts.join(hot, key).unionByName(facts.join(cold, key))
    return facts.join(hot, key).unionByName(facts.join(hot, key, "left_anti").join(cold, key, how))
