"""Column profile, choice of columns, and trimming of a table before discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.encode import as_text


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column, from one scan: (column, n_distinct, n_null, null_pct, unique_pct,
    top_pct, mean_group, max_group, skew).

    Null counts as a value in groups; ``n_distinct`` leaves it out. ``skew`` is the largest
    group over the mean group. An empty table gives no rows.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), as_text(F.col(f"`{c}`")).alias("value"), F.col(f"`{c}`").isNull().alias("is_null")) for c in df.columns]))
    groups = df.select(cells.alias("x")).select("x.*").groupBy("column", "value", "is_null").agg(F.count("*").alias("n"))
    facts = groups.groupBy("column").agg(
        F.count_if(~F.col("is_null")).alias("n_distinct"),
        F.coalesce(F.sum(F.when(F.col("is_null"), F.col("n"))), F.lit(0)).alias("n_null"),
        F.sum("n").alias("n"),
        F.count("*").alias("groups"),
        F.max("n").alias("max_group"),
    )
    pct = lambda x: 100.0 * F.col(x) / F.col("n")
    mean = F.col("n") / F.col("groups")
    return facts.select("column", "n_distinct", "n_null", pct("n_null").alias("null_pct"), pct("n_distinct").alias("unique_pct"), pct("max_group").alias("top_pct"), mean.alias("mean_group"), "max_group", (F.col("max_group") / mean).alias("skew"))


def choose_columns(df: DataFrame, k: int, key_pct: float = 95.0) -> list[str]:
    """At most ``k`` columns: no constants, one key, the rest from three strata of cardinality in
    turn, the most skewed of each first. Profiles are one row per column and ranked by Spark."""
    profile = column_profile(df).filter((F.col("n_distinct") + (F.col("n_null") > 0).cast("int")) > 1)
    key = Window.orderBy(F.desc(F.col("unique_pct")), "column")
    ranked = profile.withColumn("key", F.when(F.col("unique_pct") >= key_pct, F.row_number().over(key)))
    rest = ranked.filter("key is null").withColumn("stratum", F.ntile(3).over(Window.orderBy("n_distinct", "column")))
    turn = rest.withColumn("turn", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("skew"), "column")))
    chosen = [r["column"] for r in ranked.filter("key = 1").select("column").collect()]
    return [*chosen, *[r["column"] for r in turn.orderBy("turn", "stratum").select("column").collect()]][:k]


def trim(df: DataFrame, n: int, how: str = "head", seed: int = 42) -> DataFrame:
    """``n`` rows, the first or a random choice, with columns renamed c0, c1, ..."""
    rows = df.limit(n) if how == "head" else df.orderBy(F.rand(seed)).limit(n)
    return rows.toDF(*[f"c{i}" for i in range(len(df.columns))])
