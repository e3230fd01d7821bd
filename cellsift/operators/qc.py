"""Building an experiment, splitting droplets, filtering genes, and reading results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Experiment
from ..storage import written


def gene_aggregates(counts: DataFrame, genes: DataFrame, n_droplets: DataFrame) -> DataFrame:
    """genes with mean (over all droplets, zeros too), total_counts and n_cells (droplets with more than 0); n_droplets: one row, _n."""
    sums = counts.groupBy("gene_idx").agg(F.sum("count").alias("total_counts"), F.count_if(F.col("count") > 0).alias("n_cells"))
    total = F.coalesce("total_counts", F.lit(0.0))
    joined = genes.select("gene_idx", "gene").join(sums, "gene_idx", "left").join(F.broadcast(n_droplets))
    return joined.select("gene_idx", "gene", F.try_divide(total, F.col("_n").cast("double")).alias("mean"), total.alias("total_counts"), F.coalesce("n_cells", F.lit(0)).cast("long").alias("n_cells"))


def droplet_aggregates(counts: DataFrame, droplets: DataFrame) -> DataFrame:
    """droplets with total_counts and n_genes (genes with more than 0)."""
    sums = counts.groupBy("droplet_idx").agg(F.sum("count").alias("total_counts"), F.count_if(F.col("count") > 0).alias("n_genes"))
    joined = droplets.join(sums, "droplet_idx", "left")
    return joined.select(*droplets.columns, F.coalesce("total_counts", F.lit(0.0)).alias("total_counts"), F.coalesce("n_genes", F.lit(0)).cast("long").alias("n_genes"))


def create_experiment(counts: DataFrame, genes: DataFrame | None = None, droplets: DataFrame | None = None, name: str = "experiment", n_droplets: int | None = None) -> Experiment:
    """An experiment from counts; droplets without any count are dropped.

    Gene means are over the droplets before that, and stay so. Without dimensions, genes and droplets are
    those of the counts, named Gene<i> and Drop<i> from 1. Names must be unique (sources.make_unique).
    """
    counts = counts.select(F.col("gene_idx").cast("int"), F.col("droplet_idx").cast("long"), F.col("count").cast("double"))
    if genes is None:
        genes = counts.select("gene_idx").distinct().withColumn("gene", F.concat(F.lit("Gene"), F.col("gene_idx") + 1))
    if droplets is None:
        droplets = counts.select("droplet_idx").distinct().withColumn("droplet", F.concat(F.lit("Drop"), F.col("droplet_idx") + 1))
    n = droplets.agg((F.count("*") if n_droplets is None else F.lit(n_droplets)).alias("_n"))
    kept = droplet_aggregates(counts, droplets.select("droplet_idx", "droplet")).where("total_counts > 0")
    return Experiment(counts.where("count <> 0"), gene_aggregates(counts, genes, n), kept, name)


def set_debris_test_set(x: Experiment, min_counts: float = 100, min_genes: int = 0, top_n: int | None = None, debris_ids: DataFrame | list[str] | None = None) -> Experiment:
    """Droplets with min_counts counts and min_genes genes become the test set, all others debris.

    top_n raises min_counts to the count of the top_n-th droplet of those, ties included; 0 means no cap.
    debris_ids (names, as a list or a DataFrame with a column droplet) are debris in any case.
    """
    if top_n is not None and top_n < 0:
        raise ValueError("top_n must be at least 0")
    if min_counts < 0 or min_genes < 0:
        raise ValueError("min_counts and min_genes must be at least 0")
    droplets = written(x.droplets.drop("set"), "droplets")
    keep = (F.col("total_counts") >= float(min_counts)) & (F.col("n_genes") >= min_genes)
    if top_n:
        nth = droplets.where(keep).orderBy(F.desc("total_counts"), "droplet_idx").limit(top_n).agg(F.count("*").alias("n"), F.min("total_counts").alias("least")).first()
        if nth.n == top_n and nth.least > min_counts:
            keep = (F.col("total_counts") >= nth.least) & (F.col("n_genes") >= min_genes)
    marked = droplets.withColumn("set", F.when(keep, "test").otherwise("debris"))
    if debris_ids is not None:
        ids = debris_ids if isinstance(debris_ids, DataFrame) else x.droplets.sparkSession.createDataFrame([(d,) for d in debris_ids], "droplet string")
        named = ids.select("droplet").distinct().withColumn("_named", F.lit(True))
        marked = marked.join(named, "droplet", "left").withColumn("set", F.when(F.col("_named"), "debris").otherwise(F.col("set"))).drop("_named").select(*droplets.columns, "set")
        marked = written(marked, "droplets")
    if marked.where("set = 'test'").limit(2).count() < 2:
        raise ValueError("the test set has fewer than two droplets: lower min_counts or min_genes")
    return x.with_(droplets=marked)


def filter_genes(x: Experiment, cpm_thresh: float = 0) -> Experiment:
    """Marks genes with more than cpm_thresh counts per million of all counts as expressed."""
    if not x.has_sets:
        raise ValueError("call set_debris_test_set first")
    genes = written(x.genes.drop("exprsd"), "genes")
    total = genes.agg(F.sum("total_counts").alias("_all"))
    # one row
    marked = genes.join(F.broadcast(total)).withColumn("exprsd", F.lit(1e6) * F.col("total_counts") / F.col("_all") > cpm_thresh).drop("_all")
    if marked.where("exprsd").isEmpty():
        raise ValueError("no gene passes the threshold")
    return x.with_(genes=marked)


def gene_percent(x: Experiment, genes: list[str], name: str) -> Experiment:
    """Adds to the droplets the percentage of their counts that the genes have; each gene must be there, and named once."""
    found = [r.gene_idx for r in x.genes.where(F.col("gene").isin(genes)).select("gene_idx").collect()]
    if len(found) != len(genes):
        raise ValueError("all genes must be in the experiment, each named once")
    part = x.counts.groupBy("droplet_idx").agg((100 * F.try_divide(F.sum(F.when(F.col("gene_idx").isin(found), F.col("count")).otherwise(0.0)), F.sum("count"))).alias(name))
    return x.with_(droplets=x.droplets.drop(name).join(part, "droplet_idx", "left"))


def genes_like(x: Experiment, pattern: str) -> list[str]:
    """Names of genes that a regular expression finds, whatever their case."""
    return [r.gene for r in x.genes.where(F.col("gene").rlike(f"(?i){pattern}")).orderBy("gene_idx").select("gene").collect()]


def droplet_data(x: Experiment, min_counts: float = 1, kind: str = "test") -> DataFrame:
    """Droplets of a kind: all (min_counts doesn't count), test, clean or debris (by their call)."""
    if kind == "all" or not x.has_sets:
        return x.droplets
    data = x.test_data().where(F.col("total_counts") >= float(min_counts))
    if kind == "test":
        return data
    if kind not in ("clean", "debris"):
        raise ValueError("kind must be all, test, clean or debris")
    if "Call" not in data.columns:
        raise ValueError("call call_targets first")
    return data.where(F.col("Call") == kind.capitalize())


def gene_data(x: Experiment, min_droplets: int = 1) -> DataFrame:
    return x.genes.where(F.col("n_cells") >= min_droplets)


def debris_genes(x: Experiment, p_adj: float = 0.05, log_fc: float = 0) -> DataFrame:
    if x.debris_genes is None:
        raise ValueError("call estimate_dbr_score first")
    return x.debris_genes.where((F.col("p_adj") < p_adj) & (F.col("logFC") > log_fc))


def raw_counts(x: Experiment, kind: str = "test") -> DataFrame:
    """Counts of the droplets of a kind."""
    ids = droplet_data(x, 0, kind).select("droplet_idx")
    return x.counts.join(ids, "droplet_idx", "left_semi").select("gene_idx", "droplet_idx", "count")


def clusters(x: Experiment) -> DataFrame | None:
    return None if x.calls is None else x.calls.join(x.droplets, "droplet_idx").select("droplet_idx", "droplet", "Cluster")


def alpha(x: Experiment) -> DataFrame | None:
    """gene_idx, gene, a: the fitted parameters by cluster."""
    if x.params is None:
        return None
    return x.params.alpha_frame(x.counts.sparkSession).join(x.genes.select("gene_idx", "gene"), "gene_idx")


def barcode_rank(droplets: DataFrame) -> DataFrame:
    """total_counts, rank: droplets by falling totals, the first rank of each total.

    A total's first rank is one more than the number of droplets above it, so droplets are counted by total
    before they are ranked: only the distinct totals are ever in one order.
    """
    counts = droplets.groupBy("total_counts").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("total_counts")).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("total_counts", (F.coalesce(F.sum("n").over(above), F.lit(0)) + 1).cast("long").alias("rank"))
