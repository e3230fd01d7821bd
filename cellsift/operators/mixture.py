"""Semi-supervised mixtures of multinomials or Dirichlet-multinomials, fitted by EM.

Droplets are rows of arrays. An iteration is one pass over the test droplets: parameters go out with the
tasks, each task computes its droplets' responsibilities and gives sums by gene and cluster, which Spark
adds up. Nothing is shuffled but those sums, and no state is kept on executors: the responsibilities
before, which the stop rule needs, are computed again from the parameters before. The debris droplets'
responsibilities are fixed, so their sums are taken once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lgamma as lgamma_column
from ..functions.columns import ln0, one_hot, softmax
from ..functions.special import lgamma
from ..model import Experiment, Params
from ..storage import written

# ---------------------------------------------------------------- steps as DataFrames


def multinomial_llk(counts: DataFrame, alpha: DataFrame, constants: bool = True) -> DataFrame:
    """droplet_idx, llk array<double>: log-likelihoods under each cluster's proportions alpha(gene_idx, a).

    lgamma(n + 1) - sum lgamma(x + 1) + sum x ln(a), over the genes of alpha; without constants the last term alone.
    """
    k = len(alpha.first()["a"])
    # alpha has a row for each gene
    joined = counts.join(F.broadcast(alpha), "gene_idx")
    sums = joined.groupBy("droplet_idx").agg(
        F.sum("count").alias("n"), F.sum(lgamma_column(F.col("count") + 1)).alias("c"), *[F.sum(F.col("count") * F.ln(F.col("a")[i])).alias(f"l{i}") for i in range(k)]
    )
    constant = lgamma_column(F.col("n") + 1) - F.col("c") if constants else F.lit(0.0)
    return sums.select("droplet_idx", F.array(*[constant + F.col(f"l{i}") for i in range(k)]).alias("llk"))


def responsibilities(llk: DataFrame, pi: list[float]) -> DataFrame:
    """droplet_idx, z: posterior probabilities of the clusters."""
    weights = F.array(*[ln0(F.lit(float(p))) for p in pi])
    return llk.select("droplet_idx", softmax(F.zip_with("llk", weights, lambda a, b: a + b)).alias("z"))


def mean_change(z: DataFrame, before: DataFrame) -> DataFrame:
    """delta: the mean over droplets of the summed absolute changes of z, between 0 and 2."""
    both = z.join(before.select("droplet_idx", F.col("z").alias("_old")), "droplet_idx")
    change = F.aggregate(F.zip_with("z", "_old", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, v: acc + v)
    return both.agg(F.avg(change).alias("delta"))


def mixing_weights(z: DataFrame, k: int, prior: float = 0) -> DataFrame:
    """cluster (from 1), pi: (prior + sum of z) over all clusters' sums."""
    sums = z.agg(*[F.sum(F.col("z")[i]).alias(f"s{i}") for i in range(k)])
    rows = sums.select(F.posexplode(F.array(*[F.col(f"s{i}") + prior for i in range(k)])).alias("cluster", "s"), F.aggregate(F.array(*[F.col(f"s{i}") + prior for i in range(k)]), F.lit(0.0), lambda a, v: a + v).alias("t"))
    return rows.select((F.col("cluster") + 1).alias("cluster"), (F.col("s") / F.col("t")).alias("pi"))


def multinomial_alpha(counts: DataFrame, z: DataFrame, genes: DataFrame, k: int, prior: float = 0, psc: float = 1e-10) -> DataFrame:
    """gene_idx, a: (prior + psc + sum of z times count) over the cluster's sum."""
    joined = counts.join(z, "droplet_idx")
    sums = joined.groupBy("gene_idx").agg(F.array(*[F.sum(F.col("z")[i] * F.col("count")) for i in range(k)]).alias("s"))
    none = F.array(*[F.lit(0.0)] * k)
    raised = genes.select("gene_idx").join(sums, "gene_idx", "left").select("gene_idx", F.transform(F.coalesce("s", none), lambda v: v + prior + psc).alias("s"))
    totals = raised.agg(F.array(*[F.sum(F.col("s")[i]) for i in range(k)]).alias("t"))
    # one row
    return raised.join(F.broadcast(totals)).select("gene_idx", F.zip_with("s", "t", lambda a, b: a / b).alias("a"))


def dirichlet_llk(counts: DataFrame, alpha: DataFrame) -> DataFrame:
    """droplet_idx, llk: log-likelihoods under each cluster's Dirichlet-multinomial."""
    k = len(alpha.first()["a"])
    whole = alpha.agg(F.array(*[F.sum(F.col("a")[i]) for i in range(k)]).alias("whole"))
    joined = counts.join(F.broadcast(alpha), "gene_idx")
    x = F.col("count")
    terms = [F.sum(lgamma_column(x + F.col("a")[i]) - lgamma_column(x + 1) - lgamma_column(F.col("a")[i])).alias(f"l{i}") for i in range(k)]
    sums = joined.groupBy("droplet_idx").agg(F.sum("count").alias("n"), *terms).join(F.broadcast(whole))
    n = F.col("n")
    return sums.select("droplet_idx", F.array(*[lgamma_column(n + 1) + lgamma_column(F.col("whole")[i]) - lgamma_column(n + F.col("whole")[i]) + F.col(f"l{i}") for i in range(k)]).alias("llk"))


def dirichlet_moments(counts: DataFrame, z: DataFrame, genes: DataFrame, k: int, prior: float = 0, psc: float = 1e-10) -> DataFrame:
    """gene_idx, a: the method-of-moments start: mean proportion times the cluster's largest implied precision."""
    totals = counts.groupBy("droplet_idx").agg(F.sum("count").alias("n"))
    p = counts.join(totals, "droplet_idx").join(z, "droplet_idx").withColumn("p", F.col("count") / F.col("n"))
    weight = z.agg(F.array(*[F.sum(F.col("z")[i]) for i in range(k)]).alias("w"))
    sums = p.groupBy("gene_idx").agg(F.array(*[F.sum(F.col("z")[i] * F.col("p")) for i in range(k)]).alias("s1"), F.array(*[F.sum(F.col("z")[i] * F.col("p") * F.col("p")) for i in range(k)]).alias("s2"))
    none = F.array(*[F.lit(0.0)] * k)
    rows = genes.select("gene_idx").join(sums, "gene_idx", "left").join(F.broadcast(weight)).select("gene_idx", F.coalesce("s1", none).alias("s1"), F.coalesce("s2", none).alias("s2"), "w")
    mean = F.zip_with("s1", "w", lambda s, w: F.coalesce(F.try_divide(s, w), F.lit(0.0)))
    var = F.zip_with(F.zip_with("s2", "w", lambda s, w: F.coalesce(F.try_divide(s, w), F.lit(0.0))), mean, lambda q, m: q - m * m)
    rows = rows.select("gene_idx", mean.alias("m"), var.alias("v"))
    precision = F.zip_with("m", "v", lambda m, v: F.when(v > 0, m * (1 - m) / v - 1).otherwise(0.0))
    rows = rows.withColumn("g", precision)
    most = rows.agg(F.array(*[F.max(F.col("g")[i]) for i in range(k)]).alias("most"))
    return rows.join(F.broadcast(most)).select("gene_idx", F.zip_with("m", "most", lambda m, g: m * g + psc + prior).alias("a"))


# ---------------------------------------------------------------- the fused passes


def droplet_rows(counts: DataFrame, ids: DataFrame, genes: np.ndarray) -> DataFrame:
    """droplet_idx, pos array<int>, x array<double>: a row for each droplet of ids, positions in genes; empty arrays without counts."""
    place = counts.sparkSession.createDataFrame([(int(g), i) for i, g in enumerate(genes)], "gene_idx int, pos int")
    # genes are a dimension; a droplet has at most one count for each
    rows = counts.join(F.broadcast(place), "gene_idx").groupBy("droplet_idx").agg(F.sort_array(F.collect_list(F.struct("pos", "count"))).alias("v"))
    joined = ids.select("droplet_idx").join(rows, "droplet_idx", "left")
    return joined.select("droplet_idx", F.coalesce("v.pos", F.array().cast("array<int>")).alias("pos"), F.coalesce("v.count", F.array().cast("array<double>")).alias("x"))


def flattened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and count of all counts of a batch."""
    pos, x = batch.column("pos"), batch.column("x")
    sizes = np.diff(pos.offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), sizes), pos.flatten().to_numpy(), x.flatten().to_numpy()


def cluster_logs(rows: np.ndarray, pos: np.ndarray, x: np.ndarray, n: int, p: Params, constants: bool = False) -> np.ndarray:
    """Log-likelihoods of n droplets, without terms that all clusters share unless asked for."""
    out = np.zeros((n, p.k))
    size = np.bincount(rows, weights=x, minlength=n)
    for k in range(p.k):
        if p.kind == "mltn":
            out[:, k] = np.bincount(rows, weights=x * np.log(p.alpha[pos, k]), minlength=n)
        else:
            a, whole = p.alpha[pos, k], p.alpha[:, k].sum()
            out[:, k] = np.bincount(rows, weights=lgamma(x + a) - lgamma(a), minlength=n) + lgamma(np.array(whole)) - lgamma(size + whole)
    if constants:
        out += (lgamma(size + 1) - np.bincount(rows, weights=lgamma(x + 1), minlength=n))[:, None]
    return out


def posterior(logs: np.ndarray, pi: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        logs = logs + np.log(pi)
    weights = np.exp(logs - logs.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


class Sums:
    """Sums over droplets: z by cluster, z x by gene; for Dirichlet-multinomials also moments of proportions and histograms."""

    def __init__(self, genes: int, k: int, kind: str):
        self.kind, self.z, self.change, self.n = kind, np.zeros(k), 0.0, 0
        self.zx = np.zeros((genes, k))
        self.p1, self.p2 = np.zeros((genes, k)), np.zeros((genes, k))
        self.cells: dict[tuple[int, float], np.ndarray] = {}  # (gene, count) and (-1, size): z

    def add(self, rows, pos, x, z: np.ndarray, before: np.ndarray | None = None) -> None:
        self.z += z.sum(0)
        self.n += len(z)
        if before is not None:
            self.change += np.abs(z - before).sum()
        size = np.bincount(rows, weights=x, minlength=len(z))
        for k in range(z.shape[1]):
            self.zx[:, k] += np.bincount(pos, weights=x * z[rows, k], minlength=len(self.zx))
            if self.kind == "DM":
                share = x / size[rows]
                self.p1[:, k] += np.bincount(pos, weights=share * z[rows, k], minlength=len(self.zx))
                self.p2[:, k] += np.bincount(pos, weights=share**2 * z[rows, k], minlength=len(self.zx))
        if self.kind == "DM":
            for g, v, w in ((pos, x, z[rows]), (np.full(len(z), -1), size, z)):
                pairs, inverse = np.unique(np.column_stack([g, v]), axis=0, return_inverse=True)
                total = np.stack([np.bincount(inverse.ravel(), weights=w[:, k], minlength=len(pairs)) for k in range(z.shape[1])], 1)
                for (a, b), t in zip(pairs.tolist(), total, strict=True):
                    self.cells[a, b] = self.cells.get((a, b), 0) + t

    def rows(self) -> pd.DataFrame:
        """As rows (what, gene, value, sums) to be added up."""
        got = [("z", -1, 0.0, self.z), ("n", -1, 0.0, np.array([self.n, self.change]))]
        got += [("zx", g, 0.0, v) for g, v in enumerate(self.zx) if v.any()]
        if self.kind == "DM":
            got += [(w, g, 0.0, v) for w, m in (("p1", self.p1), ("p2", self.p2)) for g, v in enumerate(m) if v.any()]
            got += [("cell", int(g), v, t) for (g, v), t in self.cells.items()]
        return pd.DataFrame({"what": [r[0] for r in got], "gene": [r[1] for r in got], "value": [r[2] for r in got], "sums": [r[3] for r in got]})

    def take(self, collected) -> Sums:
        for r in collected:
            v = np.array(r["sums"])
            if r["what"] == "z":
                self.z += v
            elif r["what"] == "n":
                self.n += round(v[0])
                self.change += v[1]
            elif r["what"] == "cell":
                self.cells[r["gene"], r["value"]] = self.cells.get((r["gene"], r["value"]), 0) + v
            else:
                getattr(self, r["what"])[r["gene"]] += v
        return self

    def plus(self, other: Sums) -> Sums:
        out = Sums(len(self.zx), len(self.z), self.kind)
        for name in ("z", "zx", "p1", "p2"):
            setattr(out, name, getattr(self, name) + getattr(other, name))
        out.n, out.change = self.n, self.change
        out.cells = {c: self.cells.get(c, 0) + other.cells.get(c, 0) for c in {*self.cells, *other.cells}}
        return out


def summed(data: DataFrame, make_z: Callable, genes: int, k: int, kind: str) -> Sums:
    """Sums over droplet rows; make_z gives z and the z before (or None) for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Sums(genes, k, kind)
        for batch in batches:
            if batch.num_rows:
                rows, pos, x = flattened(batch)
                total.add(rows, pos, x, *make_z(batch, rows, pos, x))
        yield pa.RecordBatch.from_pandas(total.rows(), schema=shape)

    shape = pa.schema([("what", pa.string()), ("gene", pa.int32()), ("value", pa.float64()), ("sums", pa.list_(pa.float64()))])
    parts = data.mapInArrow(run, "what string, gene int, value double, sums array<double>")
    width = max(k, 2)
    added = parts.groupBy("what", "gene", "value").agg(*[F.sum(F.try_element_at("sums", F.lit(i + 1))).alias(f"s{i}") for i in range(width)])
    got = added.select("what", "gene", "value", F.array_compact(F.array(*[F.col(f"s{i}") for i in range(width)])).alias("sums")).collect()
    return Sums(genes, k, kind).take(got)


def loo_fixed_point(alpha: np.ndarray, cells: dict[int, tuple[np.ndarray, np.ndarray]], sizes: tuple[np.ndarray, np.ndarray], prior: float, psc: float, eps: float = 1e-4, max_iter: int = 10_000) -> np.ndarray:
    """The leave-one-out fixed point of one cluster's Dirichlet parameters.

    cells[gene]: distinct counts and the weight that has each; sizes: the same of droplets' sizes. Each step
    multiplies a gene's parameter by (sum of w x / (x - 1 + a)) / (sum of w n / (n - 1 + A)); the steps end
    when the summed relative change is at most eps. Only distinct values count, so a step costs the
    same for any number of droplets.
    """
    gene = np.concatenate([np.full(len(v), g) for g, (v, _) in cells.items()]) if cells else np.zeros(0, int)
    value = np.concatenate([v for v, _ in cells.values()]) if cells else np.zeros(0)
    weight = np.concatenate([w for _, w in cells.values()]) if cells else np.zeros(0)
    alpha = np.maximum(alpha, 0) + psc
    for _ in range(max_iter):
        below = (sizes[1] * sizes[0] / (sizes[0] - 1 + alpha.sum())).sum()
        if below == 0 or np.isnan(below):
            raise ValueError("the leave-one-out step has no denominator: a cluster without droplets")
        above = np.bincount(gene, weights=weight * value / (value - 1 + alpha[gene]), minlength=len(alpha))
        new = alpha * above / below + psc + prior
        change = (np.abs(new - alpha) / alpha).sum()
        alpha = new
        if np.isnan(change):
            raise ValueError("the leave-one-out step gives NaN")
        if change <= eps:
            break
    return alpha


def maximised(s: Sums, kind: str, genes: np.ndarray, alpha_prior: float, pi_prior: float, psc: float) -> Params:
    """The M-step from sums over all droplets, fixed ones too."""
    pi = (pi_prior + s.z) / (pi_prior + s.z).sum()
    if kind == "mltn":
        alpha = alpha_prior + psc + s.zx
        return Params(kind, genes, alpha / alpha.sum(0), pi)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.nan_to_num(s.p1 / s.z)
        var = np.nan_to_num(s.p2 / s.z) - mean**2
        precision = np.where(var > 0, mean * (1 - mean) / var - 1, 0.0)
    start = mean * precision.max(0) + psc + alpha_prior
    alpha = np.empty_like(start)
    for k in range(len(pi)):
        by_gene: dict[int, list] = {}
        for (g, v), w in s.cells.items():
            if w[k] > 0 and v > 0:
                by_gene.setdefault(g, []).append((v, w[k]))
        tables = {g: tuple(np.array(c) for c in zip(*sorted(pairs), strict=True)) for g, pairs in sorted(by_gene.items())}
        sizes = tables.pop(-1, (np.zeros(0), np.zeros(0)))
        alpha[:, k] = loo_fixed_point(start[:, k], tables, sizes, alpha_prior, psc)
    return Params(kind, genes, alpha, pi)


def fixed_sums(rows: DataFrame, labels: DataFrame, genes: int, k: int, kind: str) -> Sums:
    """Sums of droplets with labels (droplet_idx, label from 1, null for none)."""

    def make_z(batch, *_):
        label = np.array([0 if v is None else v for v in batch.column("label").to_pylist()])
        return np.eye(k + 1)[label][:, 1:], None

    return summed(rows.join(labels, "droplet_idx").select("pos", "x", "label"), make_z, genes, k, kind)


def params_from_labels(counts: DataFrame, labels: DataFrame, genes: np.ndarray, k: int, kind: str = "mltn", alpha_prior: float = 0, pi_prior: float = 0, psc: float = 1e-10) -> Params:
    """Parameters from one-hot responsibilities; droplets without a label count for nothing."""
    rows = droplet_rows(counts, labels, genes)
    return maximised(fixed_sums(rows, labels, len(genes), k, kind), kind, genes, alpha_prior, pi_prior, psc)


def em(test: DataFrame, fixed: Sums, start: Params, alpha_prior: float = 0, pi_prior: float = 0, max_iter: int = 1000, eps: float = 1e-4, psc: float = 1e-10) -> Params:
    """EM from given parameters over test droplet rows; fixed has the sums of the droplets whose labels stay.

    The first E-step's change doesn't count. It stops when the mean summed change of z is below eps, or after max_iter rounds.
    """
    genes, k = len(start.genes), start.k
    sc = test.sparkSession.sparkContext
    now, before = start, None
    for iteration in range(max_iter + 1):
        shared = sc.broadcast((now, before))

        def make_z(batch, rows, pos, x, shared=shared):
            new, old = shared.value
            z = posterior(cluster_logs(rows, pos, x, batch.num_rows, new), new.pi)
            return z, None if old is None else posterior(cluster_logs(rows, pos, x, batch.num_rows, old), old.pi)

        sums = summed(test, make_z, genes, k, start.kind)
        shared.destroy()
        if before is not None:
            delta = sums.change / max(1, sums.n)
            if delta < eps or iteration == max_iter:
                return replace(now, converged=bool(delta < eps), iterations=iteration)
        before, now = now, maximised(sums.plus(fixed), start.kind, start.genes, alpha_prior, pi_prior, psc)
    return replace(now, converged=False, iterations=max_iter)


def posteriors(test: DataFrame, p: Params) -> DataFrame:
    """droplet_idx, z, llk of droplet rows."""
    shared = test.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pos, x = flattened(batch)
            logs = cluster_logs(rows, pos, x, batch.num_rows, shared.value, constants=True)
            z = posterior(logs, shared.value.pi) if batch.num_rows else logs
            yield pa.RecordBatch.from_arrays([batch.column("droplet_idx"), pa.array(list(z), pa.list_(pa.float64())), pa.array(list(logs), pa.list_(pa.float64()))], names=["droplet_idx", "z", "llk"])

    return test.mapInArrow(run, "droplet_idx long, z array<double>, llk array<double>")


def params_from_posteriors(counts: DataFrame, z: DataFrame, genes: np.ndarray, k: int, kind: str = "mltn", alpha_prior: float = 0, pi_prior: float = 0, psc: float = 1e-10) -> Params:
    """Parameters from given responsibilities (droplet_idx, z array<double>)."""
    rows = droplet_rows(counts, z, genes).join(z, "droplet_idx").select("pos", "x", "z")

    def make_z(batch, *_):
        return np.array(batch.column("z").to_pylist(), float).reshape(batch.num_rows, k), None

    return maximised(summed(rows, make_z, len(genes), k, kind), kind, genes, alpha_prior, pi_prior, psc)


def run_em(x: Experiment, start: Params | DataFrame | None = None, alpha_prior: float = 0, pi_prior: float = 0, max_iter: int = 1000, eps: float = 1e-4, psc: float = 1e-10) -> Experiment:
    """Fits the mixture to the expressed genes of all droplets; debris droplets stay in their initial clusters.

    start: parameters to begin with, or responsibilities (droplet_idx, z) of all droplets; those of init otherwise.
    """
    if not x.has_sets:
        raise ValueError("call set_debris_test_set first")
    if isinstance(start, DataFrame):
        genes = np.array(sorted(r.gene_idx for r in x.expressed().collect()))
        kind = x.params.kind if x.params is not None else "mltn"
        start = params_from_posteriors(x.expressed_counts(), start, genes, len(start.first()["z"]), kind, alpha_prior, pi_prior, psc)
    start = start or x.params
    if start is None:
        raise ValueError("call init first")
    if (start.alpha <= 0).any():
        raise ValueError("parameters must be above 0")
    counts = x.expressed_counts()
    test = written(droplet_rows(counts, x.droplets.where("set = 'test'"), start.genes), "test")
    if not test.where("size(x) = 0").isEmpty():
        raise ValueError("a test droplet has no counts in the expressed genes")
    debris = x.droplets.where("set = 'debris'").select("droplet_idx")
    labels = x.labels if x.labels is not None else debris.withColumn("label", F.lit(1))
    fixed = debris.join(labels, "droplet_idx")
    sums = fixed_sums(droplet_rows(counts, debris, start.genes), fixed, len(start.genes), start.k, start.kind)
    fitted = em(test, sums, start, alpha_prior, pi_prior, max_iter, eps, psc)
    return x.with_(params=fitted, z=written(posteriors(test, fitted), "posteriors"), calls=None)


def assign_clusters(x: Experiment) -> Experiment:
    """Cluster (the first most probable) and ClusterProb of the test droplets."""
    if x.z is None:
        raise ValueError("call run_em first")
    top = F.array_max("z")
    return x.with_(calls=x.z.select("droplet_idx", F.array_position("z", top).cast("string").alias("Cluster"), top.alias("ClusterProb")))


def one_hot_labels(labels: DataFrame, k: int) -> DataFrame:
    """droplet_idx, z from droplet_idx, label."""
    return labels.select("droplet_idx", one_hot(F.col("label"), k).alias("z"))
