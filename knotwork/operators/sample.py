"""Early rejection: candidates that fail in the largest groups needn't be checked on all rows.

A sampled group is taken whole, so a failure there is final and the answer never changes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.encode import COUNT, Relation


@dataclass
class Sampling:
    """``mode`` is "manual" (the ``largest_k`` largest groups) or "auto": as many of the largest
    as cover that share of the rows, then at least ``min_k`` and at most ``max_k``. With ``from_rows``
    given, tables of fewer distinct rows are checked in full at once, which can cost less there."""

    enabled: bool = True
    mode: str = "auto"
    largest_k: int = 10
    coverage: float = 0.3
    min_k: int = 3
    max_k: int = 20
    from_rows: int = 0


def group_sizes(rel: Relation, lhs: int) -> DataFrame:
    """Rows of each group of X, repeated ones included: (columns of X, size)."""
    return rel.df.groupBy(*rel.columns(lhs)).agg(F.sum(COUNT).alias("size"))


def multi_group_sizes(rel: Relation, sets: list[int]) -> DataFrame:
    """Sizes by several left sides in one scan: (c0.., g, size); g is Spark's grouping id."""
    columns = [F.col(f"c{i}") for i in range(rel.n)]
    return rel.df.groupingSets([rel.columns(s) for s in sets], *columns).agg(F.grouping_id().alias("g"), F.sum(COUNT).alias("size"))


def largest(sizes: DataFrame, k: int) -> DataFrame:
    """The k largest groups; ties go by key, null first."""
    keys = [c for c in sizes.columns if c != "size"]
    return sizes.orderBy(F.desc("size"), *keys).limit(k)


def sampled_groups(rel: Relation, lhs: int, how: Sampling, total: int | None = None) -> DataFrame:
    """Groups of X that are checked first, with their sizes; ``total`` rows, if known.

    Only the ``max_k`` or ``largest_k`` largest are ever ordered, each task keeping its own.
    """
    sizes = group_sizes(rel, lhs)
    if how.mode == "manual":
        return largest(sizes, how.largest_k)
    keys = [c for c in sizes.columns if c != "size"]
    if total is None:
        total = rel.df.agg(F.sum(COUNT)).first()[0] or 0
    top = largest(sizes, how.max_k)
    order = Window.orderBy(F.desc("size"), *keys)
    top = top.withColumns({"rank": F.row_number().over(order), "so_far": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    # a group belongs to the prefix if those before it don't reach the coverage
    covered = (F.col("so_far") - F.col("size")) < F.lit(how.coverage * total)
    return top.filter(covered | (F.col("rank") <= how.min_k)).select(*keys, "size")


def rows_of(rel: Relation, lhs: int, groups: DataFrame) -> DataFrame:
    """The distinct rows of some groups; the groups are few and broadcast."""
    keys = [f"c{i}" for i in range(rel.n) if lhs >> i & 1]
    few = F.broadcast(groups.select(*[F.col(k).alias(f"g_{k}") for k in keys]))
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"g_{k}"))
        same = one if same is None else same & one
    return rel.df.join(few, same, "left_semi")
