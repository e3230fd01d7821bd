"""Moments of genes over droplets, zeros included, and variable genes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import loess
from ..model import Experiment


def gene_moments(values: DataFrame, n: int, value: str = "count") -> DataFrame:
    """gene_idx, mean, var: over n droplets, of which those without a row have 0; var is the sample variance.

    The rows' own variance comes from Spark's stable aggregate; the zeros' part is added to it.
    """
    v = F.col(value)
    sums = values.groupBy("gene_idx").agg(F.count(v).alias("k"), F.avg(v).alias("m"), F.coalesce(F.var_pop(v), F.lit(0.0)).alias("s"))
    size, k = float(n), F.col("k").cast("double")
    mean = F.col("m") * k / size
    spread = k * F.col("s") + F.col("m") * F.col("m") * k * (size - k) / size
    return sums.select("gene_idx", mean.alias("mean"), F.try_divide(spread, F.lit(size - 1)).alias("var"))


def weighted_moments(values: DataFrame, weights: DataFrame, value: str = "count") -> DataFrame:
    """gene_idx, mean, var: with the droplets' weights (droplet_idx, weight), zeros included; var is the population variance.

    Every droplet of the values must have a weight.
    """
    if not values.join(weights, "droplet_idx", "left_anti").isEmpty():
        raise ValueError("a droplet has no weight")
    total = weights.agg(F.sum("weight")).first()[0]
    w, v = F.col("weight"), F.col(value)
    sums = values.join(weights, "droplet_idx").groupBy("gene_idx").agg(F.sum(w).alias("sw"), F.sum(w * v).alias("s1"), F.sum(w * v * v).alias("s2"))
    mean = F.col("s1") / total
    left = F.greatest(F.lit(total) - F.col("sw"), F.lit(0.0))
    var = (F.col("s2") - 2 * mean * F.col("s1") + mean * mean * F.col("sw") + left * mean * mean) / total
    return sums.select("gene_idx", mean.alias("mean"), F.greatest(var, F.lit(0.0)).alias("var"))


def variable_genes(moments: DataFrame, n_genes: int = 2000, lss: float = 0.3) -> DataFrame:
    """gene_idx, mean, var (log10 of value + 1), fit, rsd, rank: rank by falling residual of the n_genes most variable genes, else null.

    Genes are some ten thousand at most, so one task fits them.
    """

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gene_idx").reset_index(drop=True)
        pdf["fit"] = loess(pdf["mean"].to_numpy(float), pdf["var"].to_numpy(float), lss)
        pdf["rsd"] = pdf["var"] - pdf["fit"]
        rank = np.empty(len(pdf), np.int64)
        rank[np.argsort(-pdf["rsd"].to_numpy(), kind="stable")] = np.arange(1, len(pdf) + 1)
        pdf["rank"] = pd.Series(rank, dtype="Int64").where(pd.Series(rank) <= n_genes)
        return pdf[["gene_idx", "mean", "var", "fit", "rsd", "rank"]]

    logs = moments.select("gene_idx", F.log10(F.col("mean") + 1).alias("mean"), F.log10(F.col("var") + 1).alias("var"))
    return logs.groupBy().applyInPandas(fitted, "gene_idx int, mean double, var double, fit double, rsd double, rank long")


def get_var_genes(x: Experiment, n_genes: int = 2000, lss: float = 0.3, droplets: DataFrame | None = None) -> Experiment:
    """Variable genes among the expressed ones in the test droplets, or in the given ones."""
    ids = (x.droplets.where("set = 'test'") if x.has_sets else x.droplets) if droplets is None else droplets
    ids = ids.select("droplet_idx")
    part = x.expressed_counts().join(ids, "droplet_idx", "left_semi")
    moments = x.expressed().join(gene_moments(part, ids.count()), "gene_idx", "left").select("gene_idx", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("var", F.lit(0.0)).alias("var"))
    return x.with_(vg_info=variable_genes(moments, n_genes, lss))


def variable_gene_names(x: Experiment) -> list[str]:
    if x.vg_info is None:
        raise ValueError("call get_var_genes first")
    return [r.gene for r in x.vg_info.where("rank IS NOT NULL").join(x.genes.select("gene_idx", "gene"), "gene_idx").orderBy("rank").select("gene").collect()]


def top_by_group(df: DataFrame, by: str, order: list, n: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
