"""Principal components and the initial clusters of the mixture."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.special import complete_linkage
from ..model import Experiment
from ..storage import new_path, written
from .mixture import params_from_labels
from .normalize import normalize_data
from .variable import get_var_genes

#: Hierarchical clustering holds all distances on the driver.
MAX_LINKAGE = 5000


def standardised(vectors: DataFrame, column: str) -> DataFrame:
    """droplet_idx, v: centred and scaled by the sample deviation; constant features become 0."""
    scaler = StandardScaler(withMean=True, withStd=True, inputCol=column, outputCol="v")
    return scaler.fit(vectors).transform(vectors).select("droplet_idx", "v")


def run_pca(norm: DataFrame, droplets: DataFrame, genes: list[int], n_pcs: int = 30) -> DataFrame:
    """droplet_idx, pcs: scores of the droplets on the first components of the genes, centred and scaled.

    Genes without variance count for nothing. Droplets stay sparse: they are scaled only, the covariance and
    the scores are centred in closed form. The genes' covariance is on the driver: some thousand genes.
    """
    place = norm.sparkSession.createDataFrame([(int(g), i) for i, g in enumerate(genes)], "gene_idx int, pos int")
    values = norm.join(F.broadcast(place), "gene_idx").groupBy("droplet_idx").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("cells"))
    rows = droplets.select("droplet_idx").join(values, "droplet_idx", "left")
    n = len(genes)
    cells = F.coalesce("cells", F.array().cast("array<struct<pos:int,value:double>>"))
    # a sparse vector as Spark stores it
    sparse = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(n).alias("size"), cells["pos"].alias("indices"), cells["value"].alias("values"))
    path = new_path(norm.sparkSession, "vectors")
    rows.select("droplet_idx", sparse.alias("raw")).write.parquet(path)
    vectors = norm.sparkSession.read.schema(StructType([StructField("droplet_idx", LongType()), StructField("raw", VectorUDT())])).parquet(path)
    scaler = StandardScaler(withMean=False, withStd=True, inputCol="raw", outputCol="v").fit(vectors)
    scaled = scaler.transform(vectors).select("droplet_idx", "v")
    k = min(n_pcs, n)
    model = PCA(k=k, inputCol="v", outputCol="p").fit(scaled)
    spread = scaler.std.toArray()
    centre = np.divide(scaler.mean.toArray(), spread, out=np.zeros(n), where=spread > 0) @ model.pc.toArray()
    shift = F.array(*[F.lit(float(c)) for c in centre])
    scores = model.transform(scaled).select("droplet_idx", vector_to_array("p").alias("p"))
    return scores.select("droplet_idx", F.zip_with("p", shift, lambda a, b: a - b).alias("pcs"))


def get_pcs(x: Experiment, droplets: DataFrame | None = None, min_genes: int = 200, n_var_genes: int = 2000, lss: float = 0.3, n_pcs: int = 30) -> Experiment:
    """PCs of the test droplets with min_genes genes, or of the given test droplets, over the most variable genes."""
    test = x.droplets.where("set = 'test'")
    ids = test.where(F.col("n_genes") >= min_genes) if droplets is None else test.join(droplets.select("droplet_idx"), "droplet_idx", "left_semi")
    ids = ids.select("droplet_idx")
    x = get_var_genes(x, n_var_genes, lss, ids)
    x = x.with_(vg_info=written(x.vg_info, "variable"))
    x = normalize_data(x, ids)
    genes = [r.gene_idx for r in x.vg_info.where("rank IS NOT NULL").orderBy("rank").select("gene_idx").collect()]
    return x.with_(pcs=written(run_pca(x.norm, ids, genes, n_pcs), "pcs"))


def condense_labels(labels: DataFrame, label: str = "label") -> DataFrame:
    """Labels as contiguous numbers: "1" stays 1, the others follow from 2 in the order of their names as strings."""
    names = sorted(str(r[0]) for r in labels.select(label).where(F.col(label).isNotNull()).distinct().collect())
    number = {"1": 1} | {n: i for i, n in enumerate([n for n in names if n != "1"], 2)}
    pairs = F.create_map(*[F.lit(v) for kv in number.items() for v in kv])
    return labels.withColumn(label, pairs[F.col(label).cast("string")])


def merge_small(assigned: DataFrame, centres: dict[int, np.ndarray], min_size: int = 10) -> dict[int, int]:
    """Where each cluster goes when the smallest, while below min_size, joins the nearest centre.

    assigned: droplet_idx, label. Sizes and centres are cluster-sized and live on the driver.
    """
    size = {r.label: r.n for r in assigned.groupBy("label").agg(F.count("*").alias("n")).collect()}
    centre = {c: np.array(v, float) for c, v in centres.items() if size.get(c)}
    goes = {c: c for c in centres}
    while len(centre) > 1:
        small = min(centre, key=lambda c: (size[c], c))
        if size[small] >= min_size:
            break
        to = min((c for c in centre if c != small), key=lambda c: (((centre[c] - centre[small]) ** 2).sum(), c))
        total = size[small] + size[to]
        centre[to] = (centre[to] * size[to] + centre[small] * size[small]) / total
        size[to] = total
        del centre[small]
        goes = {c: to if g == small else g for c, g in goes.items()}
    return goes


def clusters_of(x: Experiment, k: int, use: str = "kmeans", droplets: DataFrame | None = None, n_sample: int | None = None, seed: int = 1) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """droplet_idx, label (from 1) of the droplets with PCs, and the centres. PCs are standardised once more."""
    pcs = x.pcs if droplets is None else x.pcs.join(droplets.select("droplet_idx"), "droplet_idx", "left_semi")
    if n_sample is not None:
        pcs = pcs.orderBy(F.xxhash64("droplet_idx", F.lit(seed)), "droplet_idx").limit(n_sample)
    points = written(standardised(pcs.select("droplet_idx", array_to_vector("pcs").alias("raw")), "raw"), "points")
    if use == "kmeans":
        model = KMeans(k=k, featuresCol="v", predictionCol="label", seed=seed, initSteps=5, maxIter=100).fit(points)
        labels = model.transform(points).select("droplet_idx", (F.col("label") + 1).alias("label"))
        return labels, dict(enumerate(model.clusterCenters(), 1))
    if use != "hclust":
        raise ValueError("use must be kmeans or hclust")
    if points.limit(MAX_LINKAGE + 1).count() > MAX_LINKAGE:
        raise ValueError(f"hierarchical clustering takes {MAX_LINKAGE} droplets at most: give n_sample")
    rows = points.select("droplet_idx", vector_to_array("v").alias("v")).orderBy("droplet_idx").collect()
    at = np.array([r.v for r in rows])
    found = complete_linkage(at, k)
    labels = x.counts.sparkSession.createDataFrame([(r.droplet_idx, int(c)) for r, c in zip(rows, found, strict=True)], "droplet_idx long, label int")
    return labels, {int(c): at[found == c].mean(0) for c in np.unique(found)}


def init(x: Experiment, k_init: int = 20, use: str = "kmeans", droplets: DataFrame | None = None, n_sample: int | None = None, fixed: DataFrame | None = None, model: str = "mltn", merge: bool = False, min_size: int = 10, alpha_prior: float = 0, pi_prior: float = 0, psc: float = 1e-10, seed: int = 1) -> Experiment:
    """Initial clusters and parameters.

    fixed (droplet_idx, label) defaults to all debris droplets in cluster 1; its labels come first, then the
    clusters of the PCs. merge=True joins clusters below min_size to their nearest neighbours.
    """
    if x.pcs is None:
        raise ValueError("call get_pcs first")
    if model not in ("mltn", "DM"):
        raise ValueError("model must be mltn or DM")
    given = x.droplets.where("set = 'debris'").select("droplet_idx", F.lit(1).alias("label")) if fixed is None else condense_labels(fixed.select("droplet_idx", "label"))
    offset = given.agg(F.max("label")).first()[0]
    if offset is None:
        import warnings

        warnings.warn("no droplet is fixed: no cluster is tied to debris", stacklevel=2)
        offset = 1
    found, centres = clusters_of(x, k_init, use, droplets, n_sample, seed)
    if merge:
        goes = merge_small(found, centres, min_size)
        number = {g: i for i, g in enumerate(sorted(set(goes.values())), 1)}
        pairs = F.create_map(*[F.lit(v) for c, g in goes.items() for v in (c, number[g])])
        found, k = found.withColumn("label", pairs[F.col("label")]), len(number)
    else:
        k = k_init
    free = found.join(given, "droplet_idx", "left_anti")
    labels = written(given.select("droplet_idx", F.col("label").cast("int")).union(free.select("droplet_idx", (F.col("label") + offset).cast("int"))), "labels")
    genes = np.array(sorted(r.gene_idx for r in x.expressed().collect()))
    params = params_from_labels(x.expressed_counts(), labels, genes, k + offset, model, alpha_prior, pi_prior, psc)
    return x.with_(labels=labels, params=params, k_init=k_init, z=None, calls=None)
