"""Reading and writing directories, unique names, the sample experiment."""

import gzip

import pytest

from cellsift.operators import mixture, qc, scoring
from cellsift.operators.qc import create_experiment
from cellsift.sources import simulated, tenx

MATRIX = "%%MatrixMarket matrix coordinate integer general\n% made up\n4 5 6\n1 1 3\n2 1 1\n4 2 7\n1 3 2\n4 5 6\n2 5 2\n"
GENES = "id1\tA\nid2\tB\nid3\tA\nid4\tmt-C\n"
BARCODES = "AAAC-1\nAAAC-2\nCCCC-1\nGGGG-1\nTTTT-1\n"


@pytest.fixture(params=["v2", "v3"])
def folder(request, tmp_path):
    names = ("matrix.mtx", "genes.tsv", "barcodes.tsv") if request.param == "v2" else ("matrix.mtx.gz", "features.tsv.gz", "barcodes.tsv.gz")
    for name, text in zip(names, (MATRIX, GENES, BARCODES), strict=True):
        if name.endswith("gz"):
            (tmp_path / name).write_bytes(gzip.compress(text.encode()))
        else:
            (tmp_path / name).write_text(text)
    return tmp_path


def test_read(spark, folder):
    counts, genes, droplets = tenx.read_10x(spark, str(folder))
    assert sorted(tuple(r) for r in counts.collect()) == [(0, 0, 3.0), (0, 2, 2.0), (1, 0, 1.0), (1, 4, 2.0), (3, 1, 7.0), (3, 4, 6.0)]
    assert [r.gene for r in genes.orderBy("gene_idx").collect()] == ["A", "B", "A.1", "mt-C"]
    assert [r.droplet for r in droplets.orderBy("droplet_idx").collect()] == ["AAAC", "AAAC.1", "CCCC", "GGGG", "TTTT"]
    whole = tenx.read_10x(spark, str(folder), clip_end=False)[2]
    assert whole.orderBy("droplet_idx").first().droplet == "AAAC-1"
    x = tenx.experiment_from_10x(spark, str(folder))
    assert x.dim() == (4, 4)  # GGGG has no counts
    data = {r.gene: r for r in x.genes.collect()}
    assert data["A"].mean == 1.0 and data["A.1"].total_counts == 0 and data["mt-C"].n_cells == 2
    assert qc.genes_like(x, "^MT-") == ["mt-C"]
    got = {r.droplet: r.mt for r in qc.gene_percent(x, ["mt-C"], "mt").droplets.collect()}
    assert got == {"AAAC": 0, "AAAC.1": 100, "CCCC": 0, "TTTT": 75}


def test_missing_files(spark, folder):
    for f in list(folder.iterdir()):
        text = f.read_bytes()
        f.unlink()
        with pytest.raises(ValueError):
            tenx.read_10x(spark, str(folder))
        f.write_bytes(text)


def test_make_unique(spark):
    names = ["a", "a", "a.1", "b", "a", "a.2", "b.1", "b"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    got = [r.name for r in tenx.make_unique(df, "name", "i").orderBy("i").collect()]
    assert got == ["a", "a.3", "a.1", "b", "a.4", "a.2", "b.1", "b.2"]
    assert [r.name for r in tenx.make_unique(df.where("i IN (0, 1)"), "name", "i", "_").orderBy("i").collect()] == ["a", "a_1"]


def test_bundle(spark, folder, tmp_path):
    x = qc.filter_genes(qc.set_debris_test_set(tenx.experiment_from_10x(spark, str(folder)), 2))
    x = scoring.call_targets(x, droplets=["AAAC", "TTTT"])
    tenx.write_bundle(x, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out" / "counts"))
    assert {(r.gene, r.droplet, r["count"]) for r in got.collect()} == {("A", "AAAC", 3.0), ("B", "AAAC", 1.0), ("mt-C", "TTTT", 6.0), ("B", "TTTT", 2.0)}
    assert spark.read.parquet(str(tmp_path / "out" / "droplets")).count() == 2


def test_uniform_matrix(spark):
    """Splits by ids and by thresholds; the sets part all droplets."""
    import numpy as np

    x = np.random.default_rng(1).integers(0, 31, (100, 100))
    rows = [(int(g), int(d), float(x[g, d])) for g, d in zip(*np.nonzero(x), strict=True)]
    e = create_experiment(spark.createDataFrame(rows, "gene_idx int, droplet_idx long, count double"))
    got = qc.set_debris_test_set(e, 0, debris_ids=[f"Drop{i}" for i in range(1, 91)]).droplets
    assert got.where("set = 'test'").count() == 10 and got.count() == 100
    want = ((x.sum(0) >= 1500) & ((x > 0).sum(0) >= 98)).sum()
    assert qc.set_debris_test_set(e, 1500, 98).droplets.where("set = 'test'").count() == want
    assert qc.filter_genes(qc.set_debris_test_set(e, 0), 0).genes.where("exprsd").count() == 100
    shuffled = create_experiment(spark.createDataFrame(rows[::-1], "gene_idx int, droplet_idx long, count double"))
    assert sorted(map(tuple, e.genes.collect())) == sorted(map(tuple, shuffled.genes.collect()))


def test_sample_converges(spark):
    from cellsift.operators import clustering

    x = create_experiment(*simulated.sample(spark))
    x = qc.filter_genes(qc.set_debris_test_set(x, min_counts=100))
    assert x.dim() == (1001, 2451)
    x = clustering.get_pcs(x, min_genes=50, n_var_genes=200)
    assert len(x.pcs.first().pcs) == 30 and x.vg_info.where("rank IS NOT NULL").count() == 200
    x = mixture.run_em(clustering.init(x, k_init=10))
    assert x.params.converged and x.params.alpha.shape[1] == len(x.params.pi) == 11
