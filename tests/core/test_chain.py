"""The whole chain on simulated droplets whose truth is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsift.operators import clustering, expression, mixture, plots, qc, scoring
from cellsift.operators.qc import create_experiment


def simulated(seed=1):
    rng = np.random.default_rng(seed)
    debris = np.concatenate([rng.normal(90, 1, 20), rng.normal(5, 1, 80)])
    one = np.concatenate([rng.normal(10, 1, 10), rng.normal(50, 1, 50), rng.normal(10, 1, 40)])
    two = np.concatenate([rng.normal(10, 1, 10), rng.normal(10, 1, 70), rng.normal(50, 1, 20)])
    rows, i = [], 0
    for n, size, weights in ((5000, 50, debris), (100, 500, debris), (100, 500, one), (100, 500, two)):
        for x in rng.multinomial(size, weights / weights.sum(), n):
            rows += [(int(g), i, float(x[g])) for g in np.flatnonzero(x)]
            i += 1
    return rows


@pytest.fixture(scope="module")
def start(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("counts") / "counts")
    spark.createDataFrame(simulated(), "gene_idx int, droplet_idx long, count double").write.parquet(path)
    x = create_experiment(spark.read.parquet(path))
    return qc.filter_genes(qc.set_debris_test_set(x, min_counts=100, min_genes=25))


@pytest.fixture(scope="module")
def done(start):
    x = clustering.init(clustering.get_pcs(start, min_genes=10, n_var_genes=30), k_init=3, alpha_prior=0.1, pi_prior=0.1)
    x = mixture.assign_clusters(mixture.run_em(x, alpha_prior=0.1, pi_prior=0.1))
    return scoring.call_targets(scoring.estimate_dbr_score(x, thresh_genes=25), min_genes=0)


def test_calls_follow_the_truth(done):
    calls = {r.droplet_idx: r.Call for r in done.calls.collect()}
    assert len(calls) == 300
    assert all(calls[i] == ("Debris" if i < 5100 else "Clean") for i in calls)
    assert scoring.get_clean_ids(done).count() == 200
    assert scoring.get_removed_ids(done, 0).count() == 100


def test_fit(done):
    p = done.params
    assert p.converged and np.allclose(p.alpha.sum(0), 1) and np.isclose(p.pi.sum(), 1)
    z = done.z.select(F.aggregate("z", F.lit(0.0), lambda a, v: a + v).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert np.allclose(z, 1)
    rows = done.calls.toPandas()
    debris = rows["Cluster"].isin([str(c) for c in done.debris_clusters])
    assert np.isclose(rows[debris]["score_debris"].mean(), 1)
    assert np.isclose(rows.groupby("Cluster")["score_debris"].mean().min(), 0)


def test_warm_starts(done):
    again = mixture.run_em(done, done.params, 0.1, 0.1, max_iter=2)
    assert again.params.converged and np.allclose(again.params.alpha, done.params.alpha, atol=1e-4)
    fixed = done.droplets.where("set = 'debris'").select("droplet_idx", F.array(*[F.lit(float(i == 0)) for i in range(4)]).alias("z"))
    by_z = mixture.run_em(done, done.z.select("droplet_idx", "z").union(fixed), 0.1, 0.1, max_iter=2)
    assert np.allclose(by_z.params.pi, done.params.pi, atol=1e-3)


def test_results_can_be_read(done):
    assert qc.droplet_data(done, kind="clean").count() == 200 and qc.droplet_data(done, kind="debris").count() == 100
    assert qc.raw_counts(done, "clean").select("droplet_idx").distinct().count() == 200
    assert qc.debris_genes(done).count() > 0 and qc.alpha(done).count() == 100 and qc.clusters(done).count() == 300
    s = expression.summarize_clusters(done, 5).toPandas()
    assert s["n_droplets"].sum() == 300 and s["Type"].iloc[0] == "Debris" and all(len(g.split(";")) == 5 for g in s["genes"])
    assert plots.plot_dbr_score(done).count() == 300 and plots.plot_umi_gene(done, "score_debris").count() == 300
    assert plots.plot_clust(done).count() == rows_of(done)
    assert plots.plot_data(done, "Gene1", "n_genes").count() == 300
    with pytest.raises(ValueError):
        plots.plot_data(done, "nothing")
    assert scoring.get_clean_ids(scoring.call_targets(done, clusters=["debris"], thresh_score=None, min_genes=0)).count() == 200
    assert scoring.get_clean_ids(scoring.call_targets(done, droplets=["Drop5101", "none"])).count() == 1
    with pytest.raises(ValueError):
        scoring.call_targets(done, droplets=["none"])
    found = expression.de_ttest_all(qc.raw_counts(done), done.calls.select("droplet_idx", F.col("Cluster").alias("label")))
    assert found.where("p_adj >= 0.05 OR logFC <= 0").isEmpty() and not found.isEmpty()


def rows_of(x):
    return x.calls.select("Cluster").distinct().count()


def test_guards(start, spark):
    with pytest.raises(ValueError):
        mixture.run_em(start)
    with pytest.raises(ValueError):
        mixture.assign_clusters(start)
    with pytest.raises(ValueError):
        clustering.init(start)
    with pytest.raises(ValueError):
        qc.filter_genes(start, 1e7)
    with pytest.raises(ValueError):
        qc.set_debris_test_set(start, 1e9)
    with pytest.raises(ValueError):
        qc.set_debris_test_set(start, top_n=-1)
    with pytest.raises(ValueError):
        qc.gene_percent(start, ["Gene1", "Gene1"], "x")
    with pytest.raises(ValueError):
        scoring.get_clean_ids(start)


def test_dirichlet_multinomial_and_other_starts(start):
    x = clustering.get_pcs(start, min_genes=10, n_var_genes=30, n_pcs=5)
    x = clustering.init(x, k_init=2, use="hclust", model="DM", merge=True)
    x = mixture.assign_clusters(mixture.run_em(x, max_iter=3))
    rows = x.calls.toPandas()
    rows["truth"] = np.where(rows["droplet_idx"] < 5100, 0, np.where(rows["droplet_idx"] < 5200, 1, 2))
    assert rows.groupby("truth")["Cluster"].nunique().max() == 1
    assert (x.params.alpha > 0).all()


def test_objective_never_falls(start):
    """Of the semi-supervised likelihood, free and fixed droplets together, with zero priors."""
    genes = np.arange(100)
    counts = start.expressed_counts()
    labels = start.droplets.select("droplet_idx", F.when(F.col("set") == "debris", 1).otherwise((F.col("droplet_idx") % 2 + 2)).cast("int").alias("label"))
    p = mixture.params_from_labels(counts, labels, genes, 3)
    test = mixture.droplet_rows(counts, start.droplets.where("set = 'test'"), genes).persist()
    debris = start.droplets.where("set = 'debris'").select("droplet_idx", F.lit(1).alias("label"))
    rows = mixture.droplet_rows(counts, debris, genes)
    fixed = mixture.fixed_sums(rows, debris, 100, 3, "mltn")
    last = -np.inf
    for _ in range(4):
        p = mixture.em(test, fixed, p, max_iter=1, eps=0)
        free = [np.logaddexp.reduce(np.array(r.llk) + np.log(p.pi)) for r in mixture.posteriors(test, p).collect()]
        tied = (fixed.zx[:, 0] * np.log(p.alpha[:, 0])).sum() + fixed.z[0] * np.log(p.pi[0])
        assert sum(free) + tied >= last - 1e-6
        last = sum(free) + tied
