"""Corrections of p-values for multiple tests, as windows over gene-sized tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .special import hommel

METHODS = ("holm", "hochberg", "hommel", "bonferroni", "BH", "fdr", "BY", "none")


def p_adjust(df: DataFrame, method: str = "BH", p: str = "p", out: str = "p_adj", by: list[str] | None = None, order: str = "gene_idx") -> DataFrame:
    """df with the adjusted p-values; null ones stay null and don't count. `by` names groups that are adjusted apart.

    Tables of tests are gene-sized, so a group may stand in one task.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    keys = [F.col(c) for c in by or []] + [F.col(p).isNull()]
    n = F.count(p).over(Window.partitionBy(*keys)).cast("double")
    up = Window.partitionBy(*keys).orderBy(F.col(p), F.col(order))
    down = Window.partitionBy(*keys).orderBy(F.col(p).desc(), F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    value, rank = F.col(p), F.col("_rank").cast("double")
    if method == "none":
        return df.withColumn(out, value)
    if method == "bonferroni":
        return df.withColumn(out, F.when(value.isNotNull(), F.least(F.lit(1.0), value * n)))
    if method == "hommel":
        schema = df.drop(out).withColumn(out, value).schema

        def adjust(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.copy()
            there = pdf[p].notna()
            pdf[out] = pdf[p]
            pdf.loc[there, out] = hommel(pdf.loc[there, p].to_numpy())
            return pdf[[f.name for f in schema]]

        return df.drop(out).groupBy(*(by or [])).applyInPandas(adjust, schema)
    ranked = df.withColumn("_rank", F.row_number().over(up)).withColumn("_n", n)
    size = F.col("_n")
    if method in ("BH", "fdr"):
        got = F.min(value * size / rank).over(down)
    elif method == "BY":
        # 1 + 1/2 + ... + 1/n, added up along the ranks; the last sum is the largest
        sums = ranked.withColumn("_sum", F.sum(F.lit(1.0) / rank).over(up.rowsBetween(Window.unboundedPreceding, 0)))
        ranked = sums.withColumn("_harmonic", F.max("_sum").over(Window.partitionBy(*keys)))
        got = F.min(F.col("_harmonic") * value * size / rank).over(down)
    elif method == "hochberg":
        got = F.min(value * (size - rank + 1)).over(down)
    else:
        got = F.max(value * (size - rank + 1)).over(up.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(out, F.when(value.isNotNull(), F.least(F.lit(1.0), got))).drop("_rank", "_n", "_sum", "_harmonic")
