"""The debris score, and calling droplets clean or debris."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.adjust import p_adjust
from ..model import Experiment
from ..storage import written
from .expression import de_ttest, summarize_clusters
from .normalize import norm_counts


def scaled_scores(raw: DataFrame, debris: list[str]) -> DataFrame:
    """droplet_idx, score_debris from droplet_idx, Cluster, raw: 0 at the lowest cluster mean, 1 at the mean of the debris clusters' droplets."""
    lowest = raw.groupBy("Cluster").agg(F.avg("raw").alias("m")).agg(F.min("m").alias("low"))
    height = raw.where(F.col("Cluster").isin(debris)).agg(F.avg("raw").alias("top"))
    # one row each
    rows = raw.join(F.broadcast(lowest)).join(F.broadcast(height))
    return rows.select("droplet_idx", F.try_divide(F.col("raw") - F.col("low"), F.col("top") - F.col("low")).alias("score_debris"))


def estimate_dbr_score(x: Experiment, dbr_clust: list[int] | tuple[int, ...] = (1,), thresh_genes: float = 200, thresh_p: float = 0.05, thresh_logfc: float = 0, max_genes: int = 5000, p_method: str = "fdr", sf: float = 1, positional: bool = False) -> Experiment:
    """Scores test droplets by the genes that debris clusters express more.

    Debris clusters are 1, the given ones, and those whose test droplets have fewer than thresh_genes genes on
    average (positional=True takes those clusters' positions in the order of their names as strings instead
    of their numbers). Without significant genes the scores are null.
    """
    if thresh_logfc < 0:
        raise ValueError("thresh_logfc must be at least 0")
    if x.calls is None:
        raise ValueError("call assign_clusters first")
    test = x.droplets.where("set = 'test'").join(x.calls.select("droplet_idx", "Cluster", "ClusterProb"), "droplet_idx")
    averages = sorted((r.Cluster, r.m) for r in test.groupBy("Cluster").agg(F.avg("n_genes").alias("m")).collect())
    low = [i if positional else int(c) for i, (c, m) in enumerate(averages, 1) if m < thresh_genes]
    debris = tuple(sorted({1, *map(int, dbr_clust), *low}))
    names = [str(c) for c in debris]
    counts = x.expressed_counts(x.test_counts())
    values = norm_counts(counts, sf)
    c1, c2 = test.where(F.col("Cluster").isin(names)), test.where(~F.col("Cluster").isin(names))
    if c1.isEmpty():
        raise ValueError("no test droplets are in the debris clusters")
    if c2.isEmpty():
        raise ValueError("all test droplets are in the debris clusters")
    de = de_ttest(values.withColumnRenamed("value", "count"), c1, c2).join(x.genes.select("gene_idx", "gene"), "gene_idx")
    de = p_adjust(de, p_method)
    hit = (F.col("p_adj") < thresh_p) & (F.col("logFC") > thresh_logfc)
    # a gene-sized order
    rank = F.row_number().over(Window.partitionBy(hit).orderBy(F.desc("diff"), "gene_idx"))
    de = written(de.withColumn("Debris", F.coalesce(hit, F.lit(False)) & (rank <= max_genes)), "genes")
    chosen = de.where("Debris").select("gene_idx")
    base = test.select("droplet_idx", "Cluster", "ClusterProb")
    if chosen.isEmpty():
        calls = base.withColumn("score_debris", F.lit(None).cast("double"))
    else:
        raw = values.join(F.broadcast(chosen), "gene_idx", "left_semi").groupBy("droplet_idx").agg(F.sum("value").alias("raw"))
        rows = base.join(raw, "droplet_idx", "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
        calls = base.join(scaled_scores(rows, names), "droplet_idx")
    return x.with_(calls=written(calls, "calls"), debris_genes=de, debris_clusters=debris)


def called(test: DataFrame, thresh_score: float | None = 0.5, excluded: list[str] | None = None, min_genes: int = 200) -> DataFrame:
    """test with Call: Clean for droplets of other clusters with a score below the threshold (none: any) and min_genes genes.

    A null score is not below a threshold.
    """
    low = F.lit(True) if thresh_score is None else F.coalesce(F.col("score_debris") < thresh_score, F.lit(False))
    clean = ~F.col("Cluster").isin(excluded or []) & low & (F.col("n_genes") >= min_genes)
    return test.withColumn("Call", F.when(clean, "Clean").otherwise("Debris"))


def call_targets(x: Experiment, thresh_score: float | None = 0.5, clusters: list | None = None, min_genes: int = 200, droplets: list[str] | DataFrame | None = None) -> Experiment:
    """Calls test droplets Clean or Debris.

    droplets (names) are the clean ones whatever the rest says. clusters are excluded: numbers, "debris" (those
    that summarize_clusters types so) or "clean".
    """
    if droplets is not None:
        names = droplets.select("droplet") if isinstance(droplets, DataFrame) else x.droplets.sparkSession.createDataFrame([(d,) for d in droplets], "droplet string")
        test = x.test_data().drop("Call")
        marked = test.join(names.distinct().withColumn("_named", F.lit(True)), "droplet", "left")
        if marked.where("_named").isEmpty():
            raise ValueError("none of the droplets is in the test set")
        done = marked.withColumn("Call", F.when(F.col("_named"), "Clean").otherwise("Debris"))
    else:
        if x.calls is None:
            raise ValueError("call assign_clusters first")
        test = x.test_data().drop("Call")
        if thresh_score is not None and "score_debris" not in test.columns:
            raise ValueError("call estimate_dbr_score first, or give no threshold")
        excluded: list[str] = []
        for c in clusters or []:
            if c in ("debris", "clean"):
                excluded += [r.Cluster for r in summarize_clusters(x, 1).where(F.col("Type") == c.capitalize()).collect()]
            else:
                excluded.append(str(c))
        done = called(test, thresh_score, excluded, min_genes)
    keep = [c for c in ("Cluster", "ClusterProb", "score_debris") if c in done.columns]
    return x.with_(calls=written(done.select("droplet_idx", *keep, "Call"), "calls"))


def get_clean_ids(x: Experiment) -> DataFrame:
    """droplet_idx, droplet of the clean droplets."""
    if x.calls is None or "Call" not in x.calls.columns:
        raise ValueError("call call_targets first")
    return x.test_data().where("Call = 'Clean'").select("droplet_idx", "droplet")


def get_removed_ids(x: Experiment, min_genes: int = 200) -> DataFrame:
    """droplet_idx, droplet of test droplets that are called debris and have min_genes genes."""
    if x.calls is None or "Call" not in x.calls.columns:
        raise ValueError("call call_targets first")
    return x.test_data().where((F.col("Call") == "Debris") & (F.col("n_genes") >= min_genes)).select("droplet_idx", "droplet")
