"""Joins by group: a missing key is a group like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_alike(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal `by`, missing values being equal to each other: the columns of `left`, then the others of `right`.

    In a full outer join a key comes from the side that has it.  Without `by` every row meets the
    rows of `right`, which should then be one."""
    others = [c for c in right.columns if c not in by]
    apart = right.select(*[F.col(c).alias(f"_j{i}") for i, c in enumerate(by)], *others)
    same = reduce(and_, [left[c].eqNullSafe(apart[f"_j{i}"]) for i, c in enumerate(by)], F.lit(True))
    met = left.join(apart, same, how)
    if how == "full_outer":
        met = met.withColumns({c: F.coalesce(F.col(c), F.col(f"_j{i}")) for i, c in enumerate(by)})
    return met.drop(*[f"_j{i}" for i in range(len(by))])
