"""Questions to the data: do dependencies hold?

Every verdict is exact and comes from distinct counts that Spark aggregates in parallel, partial
first, and may spill. Only counts and verdicts, one per question, come to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators.encode import Relation

#: Grouping sets, or distinct counts, of one query.
WIDTH = 32


def distinct_counts(rel: Relation, masks: list[int], width: int = WIDTH) -> dict[int, int]:
    """Distinct projections on each attribute set, by grouping sets, ``width`` of them in a scan."""
    found: dict[int, int] = {}
    masks = sorted(set(masks))
    for i in range(0, len(masks), width):
        part = masks[i : i + width]
        names = [f"c{a}" for a in range(rel.n) if any(m >> a & 1 for m in part)]
        groups = rel.df.groupingSets([[F.col(c) for c in names if m >> int(c[1:]) & 1] for m in part], *[F.col(c) for c in names]).agg(F.grouping_id().alias("g"))
        # in grouping_id the first column is the highest bit, set where it is left out
        of = {sum(1 << (len(names) - 1 - k) for k, c in enumerate(names) if not m >> int(c[1:]) & 1): m for m in part}
        for r in groups.groupBy("g").count().collect():
            found[of[r["g"]]] = r["count"]
    return found


def fd_holds(counts: dict[int, int], lhs: int, a: int) -> bool:
    """X determines A if adding A gives no further projections. Nothing holds in an empty table."""
    return counts.get(lhs, 0) > 0 and counts[lhs] == counts.get(lhs | 1 << a, 0)


def level_fds(rel: Relation, wanted: list[tuple[int, list[int]]], counts: dict[int, int], width: int = WIDTH) -> set[tuple[int, int]]:
    """Which of (left side, attributes) hold; ``counts`` keeps what was counted for other levels."""
    need = {lhs for lhs, _ in wanted} | {lhs | 1 << a for lhs, rhs in wanted for a in rhs}
    counts.update(distinct_counts(rel, [m for m in need if m not in counts], width))
    return {(lhs, a) for lhs, rhs in wanted for a in rhs if fd_holds(counts, lhs, a)}


def mvd_counts(rel: Relation, lhs: int, sides: list[int], rows: DataFrame | None = None) -> DataFrame:
    """Per group of X: n_yz, and the distinct projections n_<side> of each side."""
    rows = rel.df if rows is None else rows
    counts = [F.count_distinct(F.struct(*rel.columns(s))).alias(f"n_{s}") for s in sides]
    return rows.groupBy(*rel.columns(lhs)).agg(F.count("*").alias("n_yz"), *counts)


def product_holds(y: int, z: int) -> Column:
    """Whether a group is the product of its two sides; the product is a decimal and can't overflow."""
    return F.col("n_yz").cast("decimal(38,0)") == F.col(f"n_{y}").cast("decimal(19,0)") * F.col(f"n_{z}").cast("decimal(19,0)")


def mvd_verdicts(rel: Relation, lhs: int, pairs: list[tuple[int, int]], rows: DataFrame | None = None, width: int = WIDTH) -> list[DataFrame]:
    """Verdicts (lhs, y, z, holds) of one left side's candidates, ``width`` distinct counts a query.

    A table without rows has no group that fails, so everything holds.
    """
    out, half = [], max(1, width // 2)
    for i in range(0, len(pairs), half):
        part = pairs[i : i + half]
        sides = sorted({s for p in part for s in p})
        groups = mvd_counts(rel, lhs, sides, rows)
        holds = groups.agg(*[F.coalesce(F.bool_and(product_holds(y, z)), F.lit(True)).alias(f"v{k}") for k, (y, z) in enumerate(part)])
        rows_of = F.explode(F.array(*[F.struct(F.lit(lhs).cast("long").alias("lhs"), F.lit(y).cast("long").alias("y"), F.lit(z).cast("long").alias("z"), F.col(f"v{k}").alias("holds")) for k, (y, z) in enumerate(part)]))
        out.append(holds.select(rows_of.alias("r")).select("r.*"))
    return out


def collect_verdicts(queries: list[DataFrame], batch: int = 16) -> dict[tuple[int, int], bool]:
    """(lhs, y) -> holds; ``batch`` queries run as one job."""
    found = {}
    for i in range(0, len(queries), batch):
        for r in reduce(DataFrame.unionByName, queries[i : i + batch]).collect():
            found[r["lhs"], r["y"]] = r["holds"]
    return found
