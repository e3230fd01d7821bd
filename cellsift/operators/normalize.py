"""Proportions and log-normalised counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Experiment


def with_totals(counts: DataFrame) -> DataFrame:
    """counts with _total, the droplet's sum over the genes there are. One shuffle by droplet for both."""
    totals = counts.groupBy("droplet_idx").agg(F.sum("count").alias("_total"))
    return counts.join(totals, "droplet_idx")


def proportions(counts: DataFrame) -> DataFrame:
    """gene_idx, droplet_idx, value: counts over their droplet's sum."""
    return with_totals(counts).select("gene_idx", "droplet_idx", F.try_divide("count", "_total").alias("value"))


def norm_counts(counts: DataFrame, scale_factor: float = 1e4, logt: bool = True) -> DataFrame:
    """gene_idx, droplet_idx, value: proportions times scale_factor, as log1p unless told otherwise."""
    scaled = proportions(counts).withColumn("value", F.col("value") * float(scale_factor))
    return scaled.withColumn("value", F.log1p("value")) if logt else scaled


def median_total(counts: DataFrame) -> float:
    """The exact median of the droplets' sums."""
    return counts.groupBy("droplet_idx").agg(F.sum("count").alias("t")).agg(F.median("t")).first()[0]


def normalize_data(x: Experiment, droplets: DataFrame | None = None, genes: DataFrame | None = None, use_var: bool = False, sf: float | str = "median", logt: bool = True) -> Experiment:
    """Normalises the expressed genes (or the given ones, or the variable ones) of the test droplets (or the given ones).

    Sums are over the genes that are used. sf is the scale, or "median" for the median of those sums.
    """
    if use_var:
        if x.vg_info is None:
            raise ValueError("call get_var_genes first")
        genes = x.vg_info.where("rank IS NOT NULL").select("gene_idx")
    genes = x.expressed() if genes is None else genes.select("gene_idx")
    if droplets is None:
        droplets = x.droplets.where("set = 'test'") if x.has_sets else x.droplets
    part = x.counts.join(F.broadcast(genes), "gene_idx", "left_semi").join(droplets.select("droplet_idx"), "droplet_idx", "left_semi")
    scale = median_total(part) if sf == "median" else float(sf)
    if scale is None:
        raise ValueError("no droplets to normalise")
    return x.with_(norm=norm_counts(part.select("gene_idx", "droplet_idx", "count"), scale, logt))
