"""Differential expression: Welch's test between groups of droplets, and markers of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.adjust import p_adjust
from ..functions.special import t_p_value
from ..model import Experiment
from .normalize import norm_counts


def group_moments(values: DataFrame, groups: DataFrame, value: str = "value") -> DataFrame:
    """gene_idx, label, n, mean, var over each group's droplets (droplet_idx, label), zeros included, for all genes there are.

    Pairs without any value have mean and variance 0.
    """
    sizes = groups.groupBy("label").agg(F.count("*").cast("double").alias("n"))
    v = F.col(value)
    part = values.join(groups, "droplet_idx").groupBy("gene_idx", "label").agg(F.count(v).cast("double").alias("k"), F.avg(v).alias("m"), F.coalesce(F.var_pop(v), F.lit(0.0)).alias("s"))
    # genes times labels: dimensions both, and there are few labels
    grid = part.select("gene_idx").distinct().join(F.broadcast(sizes))
    rows = grid.join(part, ["gene_idx", "label"], "left")
    k, m, s, n = F.coalesce("k", F.lit(0.0)), F.coalesce("m", F.lit(0.0)), F.coalesce("s", F.lit(0.0)), F.col("n")
    return rows.select("gene_idx", "label", "n", (m * k / n).alias("mean"), F.try_divide(k * s + m * m * k * (n - k) / n, n - 1).alias("var"))


def welch(pairs: DataFrame) -> DataFrame:
    """diff, logFC, mu1, mu2, t, dof, p from n1, mean1, var1, n2, mean2, var2, for genes with both means above 0.

    t is null where both variances are 0 and the means are equal, infinite where they differ; p follows.
    """
    e1, e2 = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    error = e1 + e2
    diff = F.col("mean1") - F.col("mean2")
    t = F.when(error > 0, diff / F.sqrt(error)).when(diff > 0, float("inf")).when(diff < 0, float("-inf"))
    dof = F.try_divide(error * error, e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    keys = [c for c in pairs.columns if c not in ("n1", "mean1", "var1", "n2", "mean2", "var2")]
    rows = pairs.where("mean1 > 0 AND mean2 > 0").select(*keys, diff.alias("diff"), (F.log2("mean1") - F.log2("mean2")).alias("logFC"), F.col("mean1").alias("mu1"), F.col("mean2").alias("mu2"), t.alias("t"), dof.alias("dof"))
    return rows.withColumn("p", F.when(F.col("t").isin(float("inf"), float("-inf")), 0.0).otherwise(t_p_value("t", "dof")))


def de_ttest(counts: DataFrame, c1: DataFrame, c2: DataFrame, normalize: bool = False, sf: float = 1) -> DataFrame:
    """Welch's test of droplets c1 against c2 (droplet_idx each) for genes with both means above 0."""
    values = norm_counts(counts, sf) if normalize else counts.withColumnRenamed("count", "value")
    groups = c1.select("droplet_idx", F.lit(1).alias("label")).union(c2.select("droplet_idx", F.lit(2).alias("label")))
    sizes = {r.label: r.n for r in groups.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if sizes.get(1, 0) < 2 or sizes.get(2, 0) < 2:
        raise ValueError("both groups need at least two droplets")
    moments = group_moments(values, groups)
    one, two = (moments.where(F.col("label") == i).select("gene_idx", *[F.col(c).alias(f"{c}{i}") for c in ("n", "mean", "var")]) for i in (1, 2))
    return welch(one.join(two, "gene_idx"))


def one_vs_rest(values: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, gene_idx and Welch's test of each label's droplets against all others.

    The rest's moments follow from those of all groups: a group's sum of squares about the rest's mean is
    its own about its mean and a shift, so nothing cancels and the values are read once.
    """
    m = group_moments(values, labels.select("droplet_idx", "label"))
    w = Window.partitionBy("gene_idx")
    n2 = F.sum("n").over(w) - F.col("n")
    sum2 = F.sum(F.col("n") * F.col("mean")).over(w) - F.col("n") * F.col("mean")
    mean_all = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    inner = F.coalesce("var", F.lit(0.0)) * (F.col("n") - 1)
    around = inner + F.col("n") * (F.col("mean") - mean_all) * (F.col("mean") - mean_all)
    rows = m.withColumn("_around", around).withColumn("_all", mean_all).withColumn("n2", n2).withColumn("mean2", F.try_divide(sum2, n2))
    rest = F.sum("_around").over(w) - F.col("_around")
    var2 = F.greatest(F.try_divide(rest - F.col("n2") * (F.col("mean2") - F.col("_all")) * (F.col("mean2") - F.col("_all")), F.col("n2") - 1), F.lit(0.0))
    pairs = rows.withColumn("var2", var2).where("n > 1 AND n2 > 1").select("gene_idx", F.col("label").alias("cluster"), F.col("n").alias("n1"), F.col("mean").alias("mean1"), F.col("var").alias("var1"), "n2", "mean2", "var2")
    return welch(pairs)


def de_ttest_all(counts: DataFrame, labels: DataFrame, normalize: bool = True, sf: float = 1, p_thresh: float = 0.05, logfc_thresh: float = 0, p_method: str = "bonferroni") -> DataFrame:
    """Significant genes of each label (droplet_idx, label) against the rest, with rank by falling t within the label; labels with one droplet are left out."""
    values = norm_counts(counts, sf) if normalize else counts.withColumnRenamed("count", "value")
    tests = p_adjust(one_vs_rest(values, labels), p_method, by=["cluster"])
    ranked = tests.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("t"), "gene_idx")))
    return ranked.where((F.col("p_adj") < p_thresh) & (F.col("logFC") > logfc_thresh))


def de_basic(means: DataFrame, weights: list[float], top_n: int = 20) -> DataFrame:
    """The top_n genes of each cluster by the difference of its proportion and the others' weighted mean.

    means: gene_idx, a array<double> of proportions by cluster; weights: one for each cluster. Columns
    gene_idx, cluster (from 1), p1, p2, diff, logFC, rank.
    """
    k = len(means.first()["a"])
    if len(weights) != k:
        raise ValueError("one weight for each cluster is needed")
    w = F.array(*[F.lit(float(v)) for v in weights])
    both = means.select("gene_idx", F.aggregate(F.zip_with("a", w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v).alias("_all"), F.posexplode("a").alias("pos", "p1"))
    own = w[F.col("pos")]
    p2 = F.try_divide(F.col("_all") - own * F.col("p1"), F.lit(float(sum(weights))) - own)
    rows = both.select("gene_idx", (F.col("pos") + 1).alias("cluster"), "p1", p2.alias("p2"))
    rows = rows.withColumn("diff", F.col("p1") - F.col("p2")).withColumn("logFC", F.when(F.col("p2") > 0, F.log2("p1") - F.log2("p2")))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("diff"), "gene_idx")))
    return ranked.where(F.col("rank") <= top_n)


def cluster_of_all(x: Experiment) -> DataFrame:
    """droplet_idx, Cluster, total_counts: droplets outside the test set are in cluster 1."""
    rows = x.droplets.join(x.calls.select("droplet_idx", "Cluster"), "droplet_idx", "left")
    return rows.select("droplet_idx", F.coalesce("Cluster", F.lit("1")).alias("Cluster"), "total_counts", "n_genes")


def top_genes(x: Experiment, top_n: int = 20) -> DataFrame:
    """Marker genes of the clusters from the fitted parameters, clusters weighing their counts."""
    if x.params is None or x.calls is None:
        raise ValueError("call run_em and assign_clusters first")
    spark = x.counts.sparkSession
    k = x.params.k
    totals = {int(r.Cluster): r.n for r in cluster_of_all(x).groupBy("Cluster").agg(F.sum("total_counts").alias("n")).collect()}
    share = x.params.alpha / x.params.alpha.sum(0)
    means = spark.createDataFrame([(int(g), [float(v) for v in row]) for g, row in zip(x.params.genes, share, strict=True)], "gene_idx int, a array<double>")
    found = de_basic(means, [float(totals.get(i, 0.0)) for i in range(1, k + 1)], top_n)
    return found.join(F.broadcast(x.genes.select("gene_idx", "gene")), "gene_idx")


def cluster_numbers(test: DataFrame, all_droplets: DataFrame) -> DataFrame:
    """Cluster, n_droplets, avg_n_genes, avg_n_counts[, avg_dbr_score] of the test droplets, for all clusters that any droplet has."""
    more = [F.avg("score_debris").alias("avg_dbr_score")] if "score_debris" in test.columns else [F.lit(None).cast("double").alias("avg_dbr_score")]
    sums = test.groupBy("Cluster").agg(F.count("*").alias("n_droplets"), F.avg("n_genes").alias("avg_n_genes"), F.avg("total_counts").alias("avg_n_counts"), *more)
    rows = all_droplets.select("Cluster").distinct().join(sums, "Cluster", "left")
    return rows.withColumn("n_droplets", F.coalesce("n_droplets", F.lit(0)))


def summarize_clusters(x: Experiment, top_n: int = 20) -> DataFrame:
    """Type, Cluster, n_droplets, averages and the top genes joined by ";", by cluster number.

    Type is Debris for the first cluster and for those that estimate_dbr_score found, else Clean.
    """
    if x.calls is None:
        raise ValueError("call assign_clusters first")
    numbers = cluster_numbers(x.test_data(), cluster_of_all(x))
    genes = top_genes(x, top_n).groupBy(F.col("cluster").cast("string").alias("Cluster")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "gene"))), lambda v: v["gene"]), ";").alias("genes"))
    kind = F.when(F.col("Cluster").isin([str(c) for c in {1, *x.debris_clusters}]), "Debris").otherwise("Clean")
    return numbers.join(genes, "Cluster", "left").withColumn("Type", kind).orderBy(F.col("Cluster").cast("int")).select("Type", "Cluster", "n_droplets", "avg_n_genes", "avg_n_counts", "avg_dbr_score", "genes")
