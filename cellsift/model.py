"""The state of an analysis: an immutable record of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """A mixture: alpha[gene position, cluster], pi[cluster]; genes[position] is the gene_idx. kind is 'mltn' or 'DM'.

    Genes times clusters are a few million numbers at most and live on the driver.
    """

    kind: str
    genes: np.ndarray
    alpha: np.ndarray
    pi: np.ndarray
    converged: bool | None = None
    iterations: int = 0

    @property
    def k(self) -> int:
        return len(self.pi)

    def alpha_frame(self, spark, log: bool = False) -> DataFrame:
        """gene_idx, a array<double>."""
        values = np.log(self.alpha) if log else self.alpha
        rows = [(int(g), [float(x) for x in v]) for g, v in zip(self.genes, values, strict=True)]
        return spark.createDataFrame(rows, "gene_idx int, a array<double>")


@dataclass(frozen=True)
class Experiment:
    """Counts of genes in droplets and what is known of both.

    counts(gene_idx, droplet_idx, count) has the non-zero counts only; zeros count in means and variances.
    genes(gene_idx, gene, mean, total_counts, n_cells[, exprsd]); droplets(droplet_idx, droplet, total_counts,
    n_genes[, set, further features]). Indices break ties, as the order of rows and columns would.
    """

    counts: DataFrame
    genes: DataFrame
    droplets: DataFrame
    name: str = "experiment"
    norm: DataFrame | None = None
    pcs: DataFrame | None = None
    vg_info: DataFrame | None = None
    labels: DataFrame | None = None  # droplet_idx, label: the initial clusters
    k_init: int | None = None
    params: Params | None = None
    z: DataFrame | None = None  # droplet_idx, z, llk of the test droplets
    calls: DataFrame | None = None  # droplet_idx, Cluster, ClusterProb[, score_debris, Call]
    debris_genes: DataFrame | None = None
    debris_clusters: tuple[int, ...] = (1,)

    def with_(self, **changes) -> Experiment:
        return replace(self, **changes)

    @property
    def has_sets(self) -> bool:
        return "set" in self.droplets.columns

    def dim(self) -> tuple[int, int]:
        """Genes, droplets."""
        return self.genes.count(), self.droplets.count()

    def rownames(self) -> list[str]:
        return [r.gene for r in self.genes.orderBy("gene_idx").select("gene").collect()]

    def colnames(self) -> DataFrame:
        """droplet_idx, droplet: not collected, there may be very many."""
        return self.droplets.select("droplet_idx", "droplet")

    def test_data(self) -> DataFrame:
        """The test droplets with all that is known of them."""
        test = self.droplets.where("set = 'test'") if self.has_sets else self.droplets
        return test.join(self.calls, "droplet_idx", "left") if self.calls is not None else test

    def expressed(self) -> DataFrame:
        """gene_idx of the genes that passed the filter, all genes before it."""
        return (self.genes.where("exprsd") if "exprsd" in self.genes.columns else self.genes).select("gene_idx")

    def test_counts(self) -> DataFrame:
        return self.counts.join(self.droplets.where("set = 'test'").select("droplet_idx"), "droplet_idx", "left_semi").select("gene_idx", "droplet_idx", "count")

    def expressed_counts(self, counts: DataFrame | None = None) -> DataFrame:
        # Genes are a dimension of at most some ten thousand rows.
        return (self.counts if counts is None else counts).join(F.broadcast(self.expressed()), "gene_idx", "left_semi").select("gene_idx", "droplet_idx", "count")
