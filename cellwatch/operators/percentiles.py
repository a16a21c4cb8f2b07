"""Exact percentiles of columns of any size: only the values near the wanted rank are shuffled and sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: The error of the approximate quantiles is at most a share of 1 / ACCURACY of the values, a tenth of the margin on either side of the wanted rank. Columns
#: of no more than WHOLE values are sorted whole; above that, the rounding of ranks is less than the margin as well.
ACCURACY, MARGIN, WHOLE = 10_000, 0.001, 10_000


def exact_percentiles(df: DataFrame, columns: list[str], share: float) -> DataFrame:
    """One row with the percentile of each column, linearly interpolated; nulls are left out, and a column without values gets null.

    A first pass brackets each column's wanted ranks by two approximate quantiles; a second counts the values below the bracket and the distinct ones
    within it, of which there are few hundredths of a per cent. Approximation decides only how wide the bracket is, never the result.
    """
    x = lambda c: F.col(c).cast("double")

    def edge(c: str, at: float):
        return F.when(F.count(x(c)) > WHOLE, F.percentile_approx(x(c), at, ACCURACY)) if 0 < at < 1 else F.lit(None).cast("double")

    ends = [F.struct(F.lit(i).alias("k"), F.count(x(c)).alias("total"), edge(c, share - MARGIN).alias("lo"), edge(c, share + MARGIN).alias("hi")) for i, c in enumerate(columns)]
    bounds = df.agg(F.array(*ends).alias("b")).select(F.explode("b").alias("b")).select("b.*")
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), x(c).alias("x")) for i, c in enumerate(columns))))
    values = df.select(each.alias("e")).select("e.*").where("x IS NOT NULL").join(F.broadcast(bounds), "k").where("hi IS NULL OR x <= hi")  # one row a column
    # all values below the bracket are one null
    counts = values.groupBy("k", "total", F.when(F.col("lo").isNull() | (F.col("x") >= F.col("lo")), F.col("x")).alias("v")).agg(F.count("*").alias("n"))
    end = F.sum("n").over(Window.partitionBy("k").orderBy(F.asc_nulls_first("v")))
    place = (F.col("total") - 1) * share
    rows = counts.withColumns({"end": end, "low": F.floor(place), "high": F.ceil(place), "part": place - F.floor(place)}).withColumn("first", F.col("end") - F.col("n"))
    at = lambda r: F.when((F.col("first") <= F.col(r)) & (F.col(r) < F.col("end")), F.col("v"))
    found = rows.select("k", at("low").alias("a"), at("high").alias("b"), "part")
    of = lambda i, c: F.max(F.when(F.col("k") == i, F.col(c)))
    return found.agg(*((of(i, "a") + (of(i, "b") - of(i, "a")) * of(i, "part")).alias(c) for i, c in enumerate(columns)))
