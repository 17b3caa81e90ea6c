"""Relations: rows without duplicates and their multiplicity, in one of three representations.

Dependencies concern distinct rows only, while sampling looks at row counts; a relation keeps
both, as distinct rows with a count. All operators address columns by position as c0, c1, ...
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions import bits as B

COUNT = "n_rows"


def as_text(c: Column) -> Column:
    """Text by which values of a column are put in order; null reads None."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def column_distinct(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct values of all columns in one scan: (column, value as text, is_null)."""
    columns = columns or df.columns
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), as_text(F.col(f"`{c}`")).alias("value"), F.col(f"`{c}`").isNull().alias("is_null")) for i, c in enumerate(columns)]))
    return df.select(cells.alias("x")).select("x.*").distinct()


def dictionary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Ids from 1 of each column's values in text order: (column, value, is_null, id).

    Values are range-partitioned; a value's id is its place in its partition after the counts of
    the partitions before, so no column is ranked in one task.
    """
    placed = column_distinct(df, columns).repartitionByRange("column", "value", "is_null").sortWithinPartitions("column", "value", "is_null")
    placed = placed.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).persist(StorageLevel.MEMORY_AND_DISK)
    parts = placed.groupBy("column", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(parts.withColumn("before", before), ["column", "part"]).select("column", "value", "is_null", (F.col("at") - F.col("first") + F.col("before") + 1).cast("int").alias("id"))


def cardinalities(ids: DataFrame, n: int) -> list[int]:
    """Distinct values per column, null included."""
    found = {r["column"]: r["n"] for r in ids.groupBy("column").agg(F.count("*").alias("n")).collect()}
    return [found.get(i, 0) for i in range(n)]


def encode(df: DataFrame, ids: DataFrame, columns: list[str] | None = None, small: int = 100_000, sizes: list[int] | None = None) -> DataFrame:
    """Each value replaced by its id as e0, e1, ...; unknown values by 0. Other columns stay.

    A column's dictionary is broadcast up to ``small`` entries and joined by shuffle beyond.
    """
    columns = columns or df.columns
    sizes = sizes or cardinalities(ids, len(columns))
    out = df
    for i, c in enumerate(columns):
        own = ids.filter(F.col("column") == i).select(F.col("value").alias("_value"), F.col("is_null").alias("_null"), F.col("id").alias("_id"))
        own = F.broadcast(own) if sizes[i] <= small else own
        same = (as_text(F.col(f"`{c}`")) == F.col("_value")) & (F.col(f"`{c}`").isNull() == F.col("_null"))
        out = out.join(own, same, "left").withColumn(f"e{i}", F.coalesce("_id", F.lit(0))).drop("_value", "_null", "_id")
    return out.drop(*columns)


@dataclass
class Relation:
    """Distinct rows with their counts; ``df`` has c0 ... c{n-1} and the count."""

    df: DataFrame
    names: list[str]
    representation: str
    cardinality: list[int] | None = None
    bits: int | None = None
    held: list[DataFrame] = field(default_factory=list)

    @property
    def n(self) -> int:
        return len(self.names)

    def columns(self, mask: int) -> list[Column]:
        return [F.col(f"c{i}") for i in range(self.n) if mask >> i & 1]

    def close(self) -> None:
        for d in self.held:
            d.unpersist()


def relation(df: DataFrame, representation: str = "raw", counts: str | None = None) -> Relation:
    """Relation of a table in the ``raw``, ``encoded`` or ``packed`` representation.

    Null is a value like any other; NaN equals itself. Packing ids of more than 63 bits in all
    falls back to encoded with a warning. ``counts`` names a column, not part of the relation, that
    says how many rows (1 or more) a row stands for. Call ``close`` to free what is held.
    """
    if representation not in ("raw", "encoded", "packed"):
        raise ValueError(f"unknown representation {representation!r}")
    names = [c for c in df.columns if c != counts]
    n = len(names)
    columns, sizes, bits, held = [f"c{i}" for i in range(n)], None, None, []
    new = iter(columns)
    df = df.toDF(*[COUNT if c == counts else next(new) for c in df.columns])
    many = F.count("*") if counts is None else F.sum(COUNT)
    if representation != "raw":
        ids = dictionary(df, columns).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(ids)
        sizes = cardinalities(ids, n)
        bits = B.bits_for(max(sizes, default=0))
        if representation == "packed" and not B.fits(n, bits):
            warnings.warn(f"{n} columns of {bits} bits don't fit into {B.ROOM}; rows stay encoded", stacklevel=2)
            representation = "encoded"
        df = encode(df, ids, columns, sizes=sizes).withColumnsRenamed({f"e{i}": c for i, c in enumerate(columns)})
    if representation == "packed":
        rows = df.groupBy(B.pack([F.col(c) for c in columns], bits).alias("packed")).agg(many.alias(COUNT)).persist(StorageLevel.MEMORY_AND_DISK)
        view = rows.select(*[B.unpack(F.col("packed"), i, n, bits).alias(f"c{i}") for i in range(n)], COUNT)
    else:
        rows = view = df.groupBy(*columns).agg(many.alias(COUNT)).persist(StorageLevel.MEMORY_AND_DISK)
    return Relation(view, names, representation, sizes, bits, [*held, rows])
