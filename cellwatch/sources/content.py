"""Whether two tables hold the same rows, told by partition, without sorting or joining rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def content_digest(df: DataFrame, by: tuple[str, ...] = ("date",), columns: list[str] | None = None) -> DataFrame:
    """``(*by, rows, digest)``: a digest of each partition's multiset of rows, whatever their order, files or tasks.

    It is the sum of two 64-bit hashes of each row, so repeated rows count, and it is exact in any order. A null differs from any value and
    from a null in another column. Sums are made before the shuffle, so a partition of any size is one row a task.
    """
    names = sorted(columns or df.columns)
    cells = [x for c in names for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    exact = lambda *salt: F.sum(F.xxhash64(*salt, *cells).cast("decimal(20,0)"))
    sums = df.groupBy(*by).agg(F.count("*").alias("rows"), exact(F.lit(1)).alias("a"), exact(F.lit("second")).alias("b"))
    return sums.select(*by, "rows", F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string")).alias("digest"))


def content_differences(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """``(*by, rows_a, rows_b, same)`` of every partition that either table has; tables with other columns or types are an error."""
    kinds = lambda df: sorted((f.name, f.dataType.simpleString()) for f in df.schema)
    if kinds(a) != kinds(b):
        raise ValueError(f"the tables differ in columns: {kinds(a)} and {kinds(b)}")
    left, right = content_digest(a, by).withColumnsRenamed({"rows": "rows_a", "digest": "d"}), content_digest(b, by).withColumnsRenamed({"rows": "rows_b", "digest": "e"})
    met = F.lit(True)
    for c in by:
        met = met & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    both = left.alias("x").join(right.alias("y"), met, "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select(*(F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in by), zero("rows_a"), zero("rows_b"), F.col("d").eqNullSafe(F.col("e")).alias("same"))
