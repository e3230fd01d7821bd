"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: defined results for every operator."""

import pytest
from pyspark.sql import functions as F

from cellsift.llm import archive, classifier, fingerprints, language, language_model, mixing, neardup, packing, quality, secrets
from cellsift.llm.base import remainder

LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
ROWS = [
    (1, "one two three four five six seven", "en", "a", 33),
    (1, "one two three four five six seven", "en", "a", 33),
    (2, None, "en", "a", None),
    (3, "", None, "b", 0),
    (4, LONG, "de", None, len(LONG)),
    (5, "one two three four five six seven", None, None, 33),
    (None, "no id here", "de", "b", 10),
    (7, " \n\t ", "en", "a", 4),
    (8, "üß é 漢字 " * 30, "fr", "b", 300),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASHING = ["held_out", "piece", "length", "sequence_id", "copy", "rate", "shuffle_key", "slot", "range", "stratum", "bins", "kept", "rep", "band", "class_id", "spans", "score", "trusted", "drawn", "word", "block", "local", "_source", "_salt", "_mine", "row", "key", "of", "cdf", "n", "a.b", "text_key", "id", "root"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)]).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, None, None), (4, 0, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")


def none(df):
    return df.limit(0)


def test_packing(docs):
    rows = packing.pack(docs).collect()
    assert len([r for r in rows if r.doc_id == 4]) > 10
    empty = [r for r in rows if r.doc_id in (2, 3)]
    assert [(r.length, r.piece, r.start) for r in empty] == [(1, 0, 0)] * 2
    assert len([r for r in rows if r.doc_id == 1]) == 2 and len([r for r in rows if r.doc_id is None]) == 1
    assert packing.pack(none(docs)).count() == 0


def test_quality(docs, labels):
    stats = quality.measures(docs)
    got = {(r.doc_id, r.base_failed, r.kept) for r in quality.verdicts(stats, quality.learn(stats, labels)).collect()}
    assert (2, True, False) in got and (3, True, False) in got and (4, False, True) in got and (None, True, False) in got
    assert stats.count() == len(ROWS)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {4, 8} - ({8} if ("8", True) in got else set()) - {d for d, f, k in got if not k}
    assert quality.keep_good(none(docs), none(labels)).count() == 0
    assert quality.verdicts(quality.measures(none(docs)), quality.Cutoffs({})).count() == 0


def test_language_model(docs):
    rows = language_model.score(docs, remainder("doc_id", 10) == 0).collect()
    assert len(rows) == len(ROWS)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 7)} == {1}
    assert {r.n_tokens for r in rows if r.doc_id == 4} == {20_001}
    assert all(r.score < 0 and r.base_score < 0 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 5)}) == 1
    assert language_model.score(none(docs), F.lit(False)).count() == 0
    unknown = language_model.score(docs, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and abs(r.score) < 1e-5 for r in unknown)


def test_mixing(docs, monkeypatch):
    got = mixing.draws(docs, temperature=1.0, volume=3.0)
    assert mixing.mix(docs).columns == docs.columns
    rows = got.collect()
    assert 2 < len({r.row.doc_id for r in rows}) <= 8
    keys = [(r.shuffle_key, r.copy) for r in rows]
    assert keys == sorted(keys)
    assert all(r.row[c] == i for r in rows for i, c in enumerate(CLASHING))
    assert mixing.mix(none(docs)).count() == 0
    assert mixing.mix(docs, {"a": 1.0}).where("source <> 'a' OR source IS NULL").count() == 0
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    salted = mixing.draws(docs, temperature=1.0, volume=3.0).collect()
    assert [(r.row, r.copy, r.shuffle_key) for r in salted] == [(r.row, r.copy, r.shuffle_key) for r in rows]


def test_archive(spark, tmp_path):
    rows = [(1, "http://a b/\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c", None), (4, "http://d", ""), (None, "http://e", "é\r\n\r\nWARC/1.1\r\n"), (5, "http://f", "y" * 300_000), (1, "http://a b/\n", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("value", F.lit(1)).withColumn("refers", F.lit(2))
    archive.write_warc(pages, str(tmp_path / "w"))
    got = archive.read_warcs(spark, str(tmp_path / "w")).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in got) == sorted([(1, 8, "response", None), (1, 8, "response", None), (2, 8, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (0, 16, "response", None), (5, 300_000, "response", None)])
    archive.write_warc(pages.limit(0), str(tmp_path / "e"))
    assert archive.read_warcs(spark, str(tmp_path / "e")).count() == 0
    archive.write_warc(pages, str(tmp_path / "m"), least_bytes=1)
    assert archive.read_warcs(spark, str(tmp_path / "m")).where("record_type = 'revisit'").count() == 1


def test_near_duplicates(docs):
    got = neardup.classes(docs)
    assert got.count() == len(ROWS)
    by = {(r.doc_id, r.class_id) for r in got.collect()}
    assert by == {(1, 1), (2, 2), (3, 2), (4, 4), (5, 1), (None, None), (7, 7), (8, 8)}
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "7", "8", "None"]
    assert neardup.classes(none(docs)).count() == 0 and neardup.one_of_each(none(docs)).count() == 0


def test_near_duplicates_keep_every_text(spark):
    """Null and equal ids with different texts are different documents; equal rows are one."""
    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    near = words[3].replace("d30", "x")
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (3, words[2]), (3, words[3]), (3, words[3]), (7, near), (8, words[4]), (None, words[4]), (0, words[5]), (None, words[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS `root`", "2 AS text_key", "3 AS `id`", "4 AS `a.b`", "5 AS rep", "6 AS part")
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(None, words[0]), (None, words[1]), (3, words[2]), (3, words[3]), (8, words[4]), (0, words[5])], key=str)
    ids = [(r.doc_id, r.class_id, bytes(r.class_key)) for r in neardup.classes(docs).collect()]
    assert len(ids) == len(rows) and len({k for _, _, k in ids}) == 6
    assert {c for d, c, _ in ids if d == 7} == {3} and {c for d, c, _ in ids if d in (0, 8)} == {0, 8}


def test_language(docs):
    raw = language.dictionaries(docs)
    assert set(raw) == {"en", "de", "fr"}
    rows = {r.doc_id: r for r in language.identify(docs, raw).collect()}
    assert rows[2].lang_pred == rows[3].lang_pred == rows[7].lang_pred == "und" and not rows[2].accepted
    assert rows[4].lang_pred in raw and all(0 <= r.score <= 1 for r in rows.values())
    assert language.dictionaries(none(docs)) == {}
    assert language.identify(docs, {}).where("lang_pred <> 'und'").count() == 0


def test_secrets(docs):
    assert secrets.find_secrets(docs).count() == len(ROWS)
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.where("text IS NULL").count() == 1 and clean.count() == len(ROWS)
    assert secrets.redact(none(docs)).count() == 0


def test_fingerprints(docs):
    rows = fingerprints.fingerprint_edits(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[5].fingerprint and by[2].fingerprint == "" and by[2].near_next == 1.0 and by[4].n_chars == len(LONG)
    assert by[None].near_edited < 1 and by[8].near_next == fingerprints.likeness(*fingerprints.fingerprints([ROWS[8][1], "no id here"]))
    assert fingerprints.fingerprint_edits(none(docs)).count() == 0
    one = fingerprints.fingerprint_edits(docs.where("doc_id = 4")).first()
    assert one.near_next == 1.0


def test_classifier(docs, labels):
    rows = classifier.score(docs, classifier.learn(docs, labels)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert classifier.learn(none(docs), none(labels)) is None
    assert {r.score for r in classifier.score(docs, None).collect()} == {0.5}
