"""The data behind the plots; drawing is left to the user's library."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Experiment
from .qc import barcode_rank


def barcode_rank_plot(x: Experiment) -> DataFrame:
    return barcode_rank(x.droplets)


def breaks_10(top: float) -> list[float]:
    """Powers of ten up to the axis' top."""
    return [10.0**i for i in range(0, math.floor(math.log10(top)) + 1)] if top >= 1 else []


def feature(x: Experiment, rows: DataFrame, name: str, out: str) -> DataFrame:
    """rows with column `out`: a column of theirs, or a gene's normalised counts (0 where there are none)."""
    if name in rows.columns:
        return rows.withColumn(out, F.col(name))
    gene = x.genes.where(F.col("gene") == name).select("gene_idx").head(1) if x.norm is not None else []
    if not gene:
        raise ValueError(f"{name} is neither a column nor a normalised gene")
    values = x.norm.where(F.col("gene_idx") == gene[0].gene_idx).select("droplet_idx", F.col("value").alias(out))
    return rows.join(values, "droplet_idx", "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def scaled(c: Column, log: bool) -> Column:
    return F.when(c > 0, F.log10(c)) if log else c


def plot_data(x: Experiment, feat_x: str = "total_counts", feat_y: str = "n_genes", log_x: bool = False, log_y: bool = False, color: str | None = None, kind: str = "test") -> DataFrame:
    """droplet_idx, x, y[, color]; axes as log10 where asked for (values of 0 become null)."""
    if kind not in ("test", "all"):
        raise ValueError("kind must be test or all")
    rows = x.test_data() if kind == "test" else x.droplets
    got = feature(x, feature(x, rows, feat_x, "x"), feat_y, "y")
    if color is not None:
        got = feature(x, got, color, "color")
    return got.select("droplet_idx", scaled(F.col("x"), log_x).alias("x"), scaled(F.col("y"), log_y).alias("y"), *(["color"] if color else []))


def plot_umi_gene(x: Experiment, color: str | None = None) -> DataFrame:
    return plot_data(x, "total_counts", "n_genes", True, True, color)


def plot_dbr_score(x: Experiment, feat: str = "n_genes", log_y: bool = True, color: str | None = None) -> DataFrame:
    if x.calls is None or "score_debris" not in x.calls.columns:
        raise ValueError("call estimate_dbr_score first")
    return plot_data(x, "score_debris", feat, False, log_y, color)


def cluster_means(rows: DataFrame, feat_x: str, feat_y: str) -> DataFrame:
    """Cluster, x, y: means of two columns, nulls left out."""
    return rows.groupBy("Cluster").agg(F.avg(feat_x).alias("x"), F.avg(feat_y).alias("y"))


def plot_clust(x: Experiment, feat_x: str = "score_debris", feat_y: str = "n_genes", log_x: bool = True, log_y: bool = False) -> DataFrame:
    if x.calls is None:
        raise ValueError("call assign_clusters first")
    rows = x.test_data()
    for f in (feat_x, feat_y):
        if f not in rows.columns:
            raise ValueError(f"{f} is not a column")
    means = cluster_means(rows, feat_x, feat_y)
    return means.select("Cluster", scaled(F.col("x"), log_x).alias("x"), scaled(F.col("y"), log_y).alias("y"))
