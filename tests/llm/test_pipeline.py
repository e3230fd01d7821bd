"""The stages one after the other, against what each says it does."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline as P
import pyarrow.parquet as pq
from test_methods import jaccard, shingle_set

from cellsift.llm import mixing, quality, secrets
from cellsift.llm.base import table, written
from pyspark.sql import functions as F
from test_edges import CLASHING

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    labels = table(spark, SF, "labels")
    seen = []
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == names
        seen.append({r.doc_id: r.text for r in docs.collect()} if name != "target_mixture" else docs.groupBy("doc_id").count().collect())
    start = {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    cutoffs = quality.learn(quality.measures(table(spark, SF, "documents")), labels)
    good = set()
    for d, r in start.items():
        base, bins = quality.measured(r["text"] or "")
        if not quality.base_failed(base[0], base[4]) and not cutoffs.rejects(r["lang"] or "", bins):
            good.add(d)
    assert set(seen[0]) == good
    sets = {d: shingle_set(t) for d, t in seen[0].items()}
    kept = set(seen[1])
    order = sorted(sets)
    near = {d: {e for e in order if e != d and (seen[0][d] == seen[0][e] or jaccard(sets[d], sets[e]) >= 0.8)} for d in order}
    assert not any(near[d] & kept for d in kept)
    reached = set(kept)
    todo = list(kept)
    while todo:
        for e in near[todo.pop()] - reached:
            reached.add(e)
            todo.append(e)
    assert reached == set(order)
    scanner = secrets.Scanner([*secrets.BASE, *secrets.ADDED])
    for d, t in seen[1].items():
        spans = scanner.scan([t.encode()])[0]
        assert (seen[2][d] == t) == (not spans)
    want = mixing.mix(spark.createDataFrame([(d, t, start[d]["lang"], start[d]["source"], len(t)) for d, t in seen[2].items()], "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted((r.doc_id, r[1]) for r in want.groupBy("doc_id").count().collect()) == sorted((r.doc_id, r[1]) for r in seen[3])
    rows = P.run(spark, SF).toPandas()
    assert rows["length"].gt(0).all() and rows.groupby("sequence_id")["length"].sum().max() <= 2048
    assert (rows["piece"] == 0).sum() == docs.count()


def test_stages_keep_columns_and_rows(spark, tmp_path):
    """Clashing names, null and equal ids, null texts; then no rows at all."""
    long = [" ".join(f"{c}{i}" for i in range(70)) for c in "abcd"]
    rows = [(None, long[0], "en", "a", 1), (None, long[1], "en", None, 2), (3, long[2], "de", "a", 3), (3, long[3], None, "b", 4), (3, long[3], None, "b", 4), (4, None, "en", "a", None), (5, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start, want in ((docs, 4), (docs.limit(0), 0)):
        now = written(start, "t")
        for name, stage in P.STAGES[:-1]:
            now = written(stage(spark, now, str(tmp_path)), "t")
            assert now.columns == docs.columns, name
            got = now.collect()
            assert all(r[c] == i for r in got for i, c in enumerate(CLASHING))
            if name in ("near_duplicates", "secret_scans"):
                assert len(got) == want and {r.text for r in got} == set(long[:want])
        assert (P.STAGES[-1][1](spark, now, str(tmp_path)).where("piece = 0").count() > 0) == (want > 0)
