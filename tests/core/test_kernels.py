"""Numeric kernels and column functions against plain formulas."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellsift.functions import columns, special
from cellsift.functions.adjust import METHODS, p_adjust
from cellsift.operators import clustering, expression, mixture, variable


def test_lgamma(spark):
    x = [1e-10, 1e-3, 0.5, 1, 1.5, 2, 7.99, 8, 123.4, 1e6]
    want = [math.lgamma(v) for v in x]
    assert np.allclose(special.lgamma(np.array(x)), want, rtol=1e-11, atol=1e-11)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select(columns.lgamma(F.col("x"))).toPandas()
    assert np.allclose(df.iloc[:, 0], want, rtol=1e-11, atol=1e-11)


def test_t_tail_against_integration():
    for t, dof in ((0.0, 3), (0.5, 1.7), (2.0, 10), (5.0, 40), (-3.3, 7.5), (12.0, 250)):
        u = (np.arange(400_000) + 0.5) / 400_000  # x = |t| / u runs from |t| to infinity
        if t == 0:
            want = 1.0
        else:
            x = abs(t) / u
            log_c = math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(dof * math.pi)
            want = 2 * np.mean(np.exp(log_c - (dof + 1) / 2 * np.log1p(x * x / dof)) * abs(t) / u**2)
        assert math.isclose(float(special.t_two_sided(np.array(t), np.array(dof))), want, rel_tol=1e-5)
    assert special.t_two_sided(np.array([np.inf]), np.array([5.0]))[0] == 0
    assert np.isnan(special.t_two_sided(np.array([np.nan]), np.array([5.0]))[0])


def test_loess_reproduces_parabolas():
    x = np.sort(np.random.default_rng(0).uniform(0, 3, 80))
    assert np.allclose(special.loess(x, 2 + x - x**2, 0.3), 2 + x - x**2)
    assert np.allclose(special.loess(np.ones(5), np.arange(5.0), 0.8), 2.0)
    y = np.random.default_rng(1).normal(size=80)
    i = 40
    near = np.argsort(abs(x - x[i]), kind="stable")[: math.floor(80 * 0.5 + 1e-5)]
    h = abs(x - x[i])[near].max()
    w = np.clip(1 - (abs(x[near] - x[i]) / h) ** 3, 0, None) ** 3
    want = np.polyval(np.polyfit(x[near] - x[i], y[near], 2, w=np.sqrt(w)), 0)
    assert math.isclose(special.loess(x, y, 0.5)[i], want, rel_tol=1e-8)


def test_complete_linkage():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 0.2, (30, 2)) for c in (0, 5, 10)])
    assert special.complete_linkage(points, 3).tolist() == [1] * 30 + [2] * 30 + [3] * 30
    for _ in range(5):
        p = rng.normal(size=(25, 2))
        parts = [[i] for i in range(25)]
        gap = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
        while len(parts) > 4:
            a, b = min(((i, j) for i in range(len(parts)) for j in range(i)), key=lambda ij: gap[np.ix_(parts[ij[0]], parts[ij[1]])].max())
            parts[b] += parts.pop(a)
        got = special.complete_linkage(p, 4)
        assert sorted(sorted(np.flatnonzero(got == c)) for c in np.unique(got)) == sorted(sorted(g) for g in parts)


def brute_adjust(p, method):
    n = len(p)
    order = np.argsort(p, kind="stable")
    s, out = np.array(p)[order], np.empty(n)
    for i in range(n):
        later = range(i, n)
        if method in ("BH", "fdr"):
            v = min(s[j] * n / (j + 1) for j in later)
        elif method == "BY":
            v = min(s[j] * n / (j + 1) for j in later) * sum(1 / (k + 1) for k in range(n))
        elif method == "hochberg":
            v = min(s[j] * (n - j) for j in later)
        elif method == "holm":
            v = max(s[j] * (n - j) for j in range(i + 1))
        elif method == "bonferroni":
            v = s[i] * n
        elif method == "none":
            v = s[i]
        out[order[i]] = min(1, v)
    return out


def brute_hommel(p):
    """The closed test with Simes' local tests, over all subsets."""
    from itertools import combinations

    n = len(p)
    out = np.zeros(n)
    for size in range(1, n + 1):
        for group in combinations(range(n), size):
            s = sorted(p[i] for i in group)
            level = min(size * v / (k + 1) for k, v in enumerate(s))
            for i in group:
                out[i] = max(out[i], level)
    return np.minimum(1, out)


@pytest.mark.parametrize("method", METHODS)
def test_p_adjust(spark, method):
    p = np.round(np.random.default_rng(3).uniform(0, 1, 9) ** 3, 3).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*p, None])], "gene_idx int, p double")
    got = p_adjust(df, method).orderBy("gene_idx").toPandas()["p_adj"]
    want = brute_hommel(p) if method == "hommel" else brute_adjust(p, method)
    assert np.allclose(got[:9].astype(float), want) and pd.isna(got[9])
    with pytest.raises(ValueError):
        p_adjust(df, "nothing")


def test_by_of_many_p_values(spark):
    """The harmonic sum is taken once, not for each row: 60,000 rows would take minutes."""
    p = np.random.default_rng(4).uniform(0, 1, 60_000) ** 3
    df = spark.createDataFrame(pd.DataFrame({"gene_idx": np.arange(len(p)), "p": p}))
    began = time.monotonic()
    got = p_adjust(df, "BY").toPandas().sort_values("gene_idx")["p_adj"].to_numpy()
    assert time.monotonic() - began < 45
    order = np.argsort(p, kind="stable")
    k = np.arange(1, len(p) + 1)
    want = np.empty(len(p))
    want[order] = np.minimum(1, np.minimum.accumulate((np.cumsum(1 / k)[-1] * p[order] * len(p) / k)[::-1])[::-1])
    assert (got == want).all()


def test_by_of_groups(spark):
    p = np.round(np.random.default_rng(5).uniform(0, 1, 40) ** 3, 3)
    groups = [0] * 3 + [1] * 36 + [2]
    rows = [(i, g, float(v)) for i, (g, v) in enumerate(zip(groups, p, strict=True))] + [(40, 1, None), (41, 3, None)]
    got = p_adjust(spark.createDataFrame(rows, "gene_idx int, g int, p double"), "BY", by=["g"]).orderBy("gene_idx").toPandas()
    assert got.columns.tolist() == ["gene_idx", "g", "p", "p_adj"]
    for g in range(3):
        assert np.allclose(got["p_adj"][got["g"] == g].dropna(), brute_adjust(p[np.array(groups) == g], "BY"))
    assert got["p_adj"][40:].isna().all()


def test_hommel_with_ties_and_zeros():
    rng = np.random.default_rng(6)
    for t in range(400):
        p = rng.uniform(0, 1, int(rng.integers(0, 10)))
        p = [p, p**6, np.round(p, 1), np.where(p < 0.3, 0, np.round(p**3, 2)), np.repeat(p[: len(p) // 3], 3) ** 2][t % 5]
        assert np.allclose(special.hommel(p.copy()), brute_hommel(p), rtol=1e-14, atol=0)


def plain_hommel(p):
    """The definition, set size by set size."""
    order = np.argsort(p, kind="stable")
    s, n = p[order], len(p)
    out = s.copy()
    for m in range(1, n + 1):
        top = m * s[n - m :] / np.arange(1, m + 1)
        out[n - m :] = np.maximum(out[n - m :], top.min())
        out[: n - m] = np.maximum(out[: n - m], np.minimum(m * s[: n - m], top[1:].min(initial=np.inf)))
    got = np.empty(n)
    got[order] = np.minimum(1, out)
    return got


def test_hommel_of_many_p_values():
    rng = np.random.default_rng(7)
    for p in (rng.uniform(0, 1, 3000) ** 4, np.round(rng.uniform(0, 1, 3000), 2) ** 2 + 1e-8, np.sort(rng.uniform(0, 1, 2999))):
        assert np.allclose(special.hommel(p), plain_hommel(p), rtol=1e-14, atol=0)
    began = time.monotonic()
    p = rng.uniform(0, 1, 200_000) ** 2
    got = special.hommel(p)
    assert time.monotonic() - began < 20  # size by size it takes minutes
    order = np.argsort(p)
    assert (np.diff(got[order]) >= -1e-15).all() and (got >= p).all() and (got <= np.minimum(1, p * len(p))).all()


def test_softmax_at_the_edges(spark):
    rows = [([1000.0, 1001.0],), ([float("-inf"), 0.0],), ([float("inf"), 1.0, float("inf")],), ([float("-inf")] * 2,)]
    df = spark.createDataFrame(rows, "v array<double>")
    got = df.select(columns.softmax(F.col("v")).alias("a"), columns.softmax_marking_infinite(F.col("v")).alias("b"), columns.log_sum_exp(F.col("v")).alias("c")).collect()
    assert np.allclose(got[0].a, [1 / (1 + math.e), math.e / (1 + math.e)]) and math.isclose(got[0].c, 1001 + math.log1p(math.exp(-1)))
    assert got[1].a == [0, 1] and got[1].b == [1, 0] and got[1].c == 0
    assert got[2].a == [1, 0, 0] and got[2].b == [1, 0, 1] and got[2].c == float("inf") and got[3].c == float("-inf")
    assert spark.range(3).select(columns.one_hot(F.col("id") + 1, 2).alias("z")).collect()[1].z == [0, 1]


def matrix(rng, genes=12, droplets=30):
    x = rng.poisson(2.0, (genes, droplets)).astype(float)
    x[:, 0] += 1
    return x


def triplets(spark, x):
    g, d = np.nonzero(x)
    return spark.createDataFrame(pd.DataFrame({"gene_idx": g, "droplet_idx": d, "count": x[g, d]})).selectExpr("cast(gene_idx as int) gene_idx", "droplet_idx", "count")


def test_moments(spark):
    rng = np.random.default_rng(4)
    x = matrix(rng)
    got = variable.gene_moments(triplets(spark, x), 30).orderBy("gene_idx").toPandas()
    assert np.allclose(got["mean"], x.mean(1)) and np.allclose(got["var"], x.var(1, ddof=1))
    w = rng.uniform(0, 1, 30)
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "droplet_idx long, weight double")
    got = variable.weighted_moments(triplets(spark, x), frame).orderBy("gene_idx").toPandas()
    mean = (x * w).sum(1) / w.sum()
    assert np.allclose(got["mean"], mean) and np.allclose(got["var"], (w * (x - mean[:, None]) ** 2).sum(1) / w.sum())
    with pytest.raises(ValueError):
        variable.weighted_moments(triplets(spark, x), frame.where("droplet_idx > 3"))


@pytest.mark.parametrize("kind", ["mltn", "DM"])
def test_fused_steps_equal_the_frames(spark, kind):
    """The arrays' E- and M-step against the DataFrame kernels and plain formulas."""
    rng = np.random.default_rng(5)
    x = matrix(rng)
    counts = triplets(spark, x)
    z = rng.dirichlet([1, 1, 1], 30)
    alpha, pi = rng.uniform(0.5, 3, (12, 3)), np.array([0.2, 0.3, 0.5])
    if kind == "mltn":
        alpha /= alpha.sum(0)
    p = mixture.Params(kind, np.arange(12), alpha, pi)
    ids = spark.range(30).withColumnRenamed("id", "droplet_idx")
    rows = mixture.droplet_rows(counts, ids, p.genes)
    got = mixture.posteriors(rows, p).orderBy("droplet_idx").toPandas()
    frame = (mixture.multinomial_llk if kind == "mltn" else mixture.dirichlet_llk)(counts, p.alpha_frame(spark)).orderBy("droplet_idx").toPandas()
    n = x.sum(0)
    lg = np.vectorize(math.lgamma)
    want = np.empty((30, 3))
    for k in range(3):
        if kind == "mltn":
            want[:, k] = lg(n + 1) - lg(x + 1).sum(0) + (x * np.log(alpha[:, [k]])).sum(0)
        else:
            a = alpha[:, [k]]
            want[:, k] = lg(n + 1) + math.lgamma(a.sum()) - lg(n + a.sum()) + (lg(x + a) - lg(x + 1) - lg(a)).sum(0)
    assert np.allclose(np.stack(got["llk"]), want) and np.allclose(np.stack(frame["llk"]), want)
    weights = np.exp(want - want.max(1, keepdims=True)) * pi
    assert np.allclose(np.stack(got["z"]), weights / weights.sum(1, keepdims=True))
    zf = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(z)], "droplet_idx long, z array<double>")
    genes = spark.createDataFrame([(i,) for i in range(12)], "gene_idx int")
    if kind == "mltn":
        sums = (x @ z) + 0.5
        got = mixture.multinomial_alpha(counts, zf, genes, 3, prior=0.5, psc=0).orderBy("gene_idx").toPandas()
        assert np.allclose(np.stack(got["a"]), sums / sums.sum(0))
    else:
        share = x / n
        mean = share @ z / z.sum(0)
        var = share**2 @ z / z.sum(0) - mean**2
        want = mean * (mean * (1 - mean) / var - 1).max(0)
        got = mixture.dirichlet_moments(counts, zf, genes, 3, psc=0).orderBy("gene_idx").toPandas()
        assert np.allclose(np.stack(got["a"]), want)


def test_leave_one_out_fixed_point():
    rng = np.random.default_rng(6)
    x = rng.multinomial(80, rng.dirichlet(np.full(8, 2.0)), 60).T.astype(float)
    w = rng.uniform(0, 1, 60)
    cells = {g: (x[g][x[g] > 0], w[x[g] > 0]) for g in range(8)}
    got = mixture.loo_fixed_point(np.ones(8), cells, (x.sum(0), w), 0, 1e-10)
    a = np.ones(8) + 1e-10
    for _ in range(10_000):
        above = np.array([(w * x[g] / np.where(x[g] > 0, x[g] - 1 + a[g], 1)).sum() for g in range(8)])
        new = a * above / (w * x.sum(0) / (x.sum(0) - 1 + a.sum())).sum() + 1e-10
        change = (abs(new - a) / a).sum()
        a = new
        if change <= 1e-4:
            break
    assert np.allclose(got, a)


def test_welch_against_formulas(spark):
    rng = np.random.default_rng(7)
    x = matrix(rng)
    one, two = np.arange(30) < 12, np.arange(30) >= 12
    ids = lambda m: spark.createDataFrame([(int(i),) for i in np.flatnonzero(m)], "droplet_idx long")
    got = expression.de_ttest(triplets(spark, x), ids(one), ids(two)).orderBy("gene_idx").toPandas()
    a, b = x[:, one], x[:, two]
    va, vb = a.var(1, ddof=1) / 12, b.var(1, ddof=1) / 18
    assert np.allclose(got["t"], (a.mean(1) - b.mean(1)) / np.sqrt(va + vb))
    assert np.allclose(got["dof"], (va + vb) ** 2 / (va**2 / 11 + vb**2 / 17))
    assert np.allclose(got["p"], special.t_two_sided(got["t"].to_numpy(), got["dof"].to_numpy()))
    labels = spark.createDataFrame([(i, "a" if i < 12 else "b" if i < 20 else "c") for i in range(30)], "droplet_idx long, label string")
    rest = expression.one_vs_rest(triplets(spark, x).withColumnRenamed("count", "value"), labels).where("cluster = 'a'").orderBy("gene_idx").toPandas()
    assert np.allclose(rest["t"], got["t"]) and np.allclose(rest["dof"], got["dof"])
    with pytest.raises(ValueError):
        expression.de_ttest(triplets(spark, x), ids(np.arange(30) == 0), ids(two))


def test_labels_and_merging(spark):
    df = spark.createDataFrame([(1, "10"), (2, "1"), (3, "2"), (4, "10"), (5, None)], "droplet_idx long, label string")
    assert [r.label for r in clustering.condense_labels(df).orderBy("droplet_idx").collect()] == [2, 1, 3, 2, None]
    sizes = spark.createDataFrame([(i, 1 if i < 20 else 2 if i < 23 else 3) for i in range(50)], "droplet_idx long, label int")
    assert clustering.merge_small(sizes, {1: np.array([0.0]), 2: np.array([1.0]), 3: np.array([9.0])}) == {1: 1, 2: 1, 3: 3}


def test_components_are_those_of_the_decomposition(spark):
    rng = np.random.default_rng(8)
    x = matrix(rng, 6, 40)
    norm = triplets(spark, x).withColumnRenamed("count", "value")
    got = clustering.run_pca(norm, spark.range(40).withColumnRenamed("id", "droplet_idx"), list(range(6)), 4).orderBy("droplet_idx").toPandas()
    v = ((x.T - x.T.mean(0)) / x.T.std(0, ddof=1))
    u, s, _ = np.linalg.svd(v, full_matrices=False)
    assert np.allclose(np.abs(np.stack(got["pcs"])), np.abs(u[:, :4] * s[:4]))
