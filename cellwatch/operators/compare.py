"""Comparison of signals: agreement, confusion, combinations and samples of disagreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cellwatch.functions.expressions import ratio


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: how often both flags, either one alone or neither is set, and the share of equal ones."""
    x, y = F.col(a) == 1, F.col(b) == 1
    out = df.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("first_only"), F.count_if(~x & y).alias("second_only"), F.count_if(~x & ~y).alias("neither"))
    same = F.col("both") + F.col("neither")
    return out.withColumn("agreement_rate", ratio(same, same + F.col("first_only") + F.col("second_only")))


def classification_metrics(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: confusion matrix, accuracy, precision and recall (0 where undefined), base rate."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    out = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    every = tp + fp + fn + tn
    return out.withColumns({"accuracy": zero(ratio(tp + tn, every)), "precision": zero(ratio(tp, tp + fp)), "recall": zero(ratio(tp, tp + fn)), "base_rate": zero(ratio(tp + fn, every))})


def three_way(anomalies: DataFrame, model: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per cell of the anomaly snapshot, with the three flags; an absent one is 0."""
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c)
    out = anomalies.select("grid_id", F.col("is_anomaly").alias("anomaly_flag"))
    out = out.join(model.select("grid_id", "model_flag"), "grid_id", "left").join(rules.select("grid_id", "rule_flag").distinct(), "grid_id", "left")
    return out.select("grid_id", flag("anomaly_flag"), flag("model_flag"), flag("rule_flag"))


def signal_combinations(flags: DataFrame) -> DataFrame:
    names = ["model_flag", "rule_flag", "anomaly_flag"]
    return flags.groupBy(*names).agg(F.count("*").alias("grids")).orderBy(F.desc("grids"), *names)


def align_signals(rows: DataFrame, zscores: DataFrame, least: float = 2.0) -> DataFrame:
    """Labelled rows with the rule's z-score at their label time; ``rule_flag`` is 0 where there is none."""
    z = zscores.select("grid_id", F.col("timestamp").alias("label_timestamp"), "z_score")
    out = rows.join(z, ["grid_id", "label_timestamp"], "left")
    return out.withColumn("rule_flag", F.coalesce((F.col("z_score") >= least).cast("int"), F.lit(0)))


def disagreement_samples(flags: DataFrame, n: int = 5) -> DataFrame:
    """The first n cells of each case in which the signals differ or agree on a finding."""
    names = {"model_flag": "model", "rule_flag": "rule", "anomaly_flag": "anomaly"}
    case = F.concat_ws("+", *(F.when(F.col(c) == 1, label) for c, label in names.items()))
    rows = flags.withColumn("case", case).where(F.col("case") != "")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("case").orderBy("grid_id"))).where(F.col("k") <= n).drop("k")
