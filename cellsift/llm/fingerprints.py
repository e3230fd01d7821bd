"""One-permutation MinHash fingerprints with optimal densification, stored as packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import salted_parts, table
from .shingles import mixed, shingled

BIN_COUNT = 256
BITS = 8


def fingerprints(texts: list[str], bins: int = BIN_COUNT, bits: int = BITS) -> list[bytes]:
    """A fingerprint for each text; b"" for a text without words.

    Each shingle hash falls into one bin by its high bits; a bin keeps its least hash. An empty bin takes the
    value of a full one that a second hash of (bin, attempt) points to, the same one in every document with
    the same full bins, so that equal bins stay as likely as the Jaccard similarity. Of each bin's value
    the low bits are kept. bins is a power of two, bits 1, 2, 4 or 8.
    """
    owner, hashes = shingled(texts)
    shift = np.uint64(64 - (bins - 1).bit_length())
    none = np.uint64(2**64 - 1)
    best = np.full(len(texts) * bins, none)
    slot = owner * bins + (hashes >> shift).astype(np.int64)
    np.minimum.at(best, slot, hashes)
    best = best.reshape(len(texts), bins)
    full = best != none
    some = full.any(axis=1)
    out = best.copy()
    row, column = np.nonzero(~full & some[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        to = (mixed(column.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(attempt)) >> shift).astype(np.int64)
        hit = full[row, to]
        out[row[hit], column[hit]] = best[row[hit], to[hit]]
        row, column = row[~hit], column[~hit]
    low = (mixed(out) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    if bits < 8:
        low = low.reshape(len(texts), -1, 8 // bits)
        low = sum(low[:, :, i] << (i * bits) for i in range(8 // bits)).astype(np.uint8)
    return [x.tobytes() if ok else b"" for x, ok in zip(low, some, strict=True)]


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """The estimated Jaccard similarity: equal low bits, less those that are equal by chance."""
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    parts = [(x >> (i * bits)) & ((1 << bits) - 1) for i in range(8 // bits)]
    same = float(np.mean([p == 0 for p in parts]))
    chance = 2.0**-bits
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def edited(text: str, after: str) -> str:
    """The last half of text replaced by as many first code points of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def places(docs: DataFrame) -> DataFrame:
    """docs with slot: twice the number of the doc_id's range; each range's first rows also stand behind the range before, in slot + 1.

    Bounds of ranges come from a sample of the ids of bounded size, some 20 for each range.
    """
    parts = 4 * salted_parts(docs.sparkSession)
    ids = docs.select("doc_id")
    every = max(1, ids.count() // (20 * parts))
    sample = np.sort(np.array([r[0] for r in ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).distinct().collect()], np.int64))
    bounds = np.unique(sample[:: max(1, len(sample) // parts)])

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, doc_id.to_numpy(), side="right"))

    first = {r[1]: r[0] for r in ids.groupBy(range_of("doc_id").alias("r")).agg(F.min("doc_id")).collect()}
    known = sorted((r, i) for i, r in first.items())
    before = {i: known[k - 1][0] for k, (_, i) in enumerate(known)}  # of the first range, the last

    @F.pandas_udf("array<int>")
    def slots(doc_id: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, doc_id.to_numpy(), side="right")
        return pd.Series([[2 * r] if (b := before.get(i)) is None else [2 * r, 2 * b + 1] for i, r in zip(doc_id.tolist(), own.tolist(), strict=True)])

    return docs.withColumn("slot", F.explode(slots("doc_id")))


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by slot, each own row with the text after it."""
    from .base import halves

    waiting: tuple[int, int, str] | None = None
    for whole in batches:
        for batch in halves(whole, 8 << 20):
            rows = list(zip(batch.column("slot").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True))
            rows = [waiting, *rows] if waiting else rows
            waiting = rows[-1] if rows[-1][0] % 2 == 0 else None
            own = [i for i, r in enumerate(rows[:-1]) if r[0] % 2 == 0]
            changed = [edited(rows[i][2], rows[i + 1][2]) for i in own]
            plain, after = fingerprints([r[2] for r in rows]), fingerprints(changed)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([rows[i][1] for i in own], pa.int64()),
                    "n_chars": pa.array([len(rows[i][2]) for i in own], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                    "fingerprint": pa.array([plain[i].hex() for i in own], pa.string()),
                    "edited_fingerprint": pa.array([x.hex() for x in after], pa.string()),
                    "near_edited": pa.array([likeness(plain[i], x) for i, x in zip(own, after, strict=True)], pa.float64()),
                    "near_next": pa.array([likeness(plain[i], plain[i + 1]) for i in own], pa.float64()),
                }
            )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """A row for each input row with the fingerprints of its text and of its edited text.

    Null texts are empty ones; a null doc_id counts as the least number. Rows with equal ids follow each
    other by text; as each has the next one's text, rows of one id (all null ids, say) are one chain in one
    task, one row of which is held at a time. The only row of a table follows itself. An empty table gives no
    rows, extra columns are ignored, texts of any length are read whole. Texts move once, to ranges of ids; a
    range's last row finds the next one's first there too.
    """
    least = F.lit(-(2**63))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = places(rows).withColumn("range", F.shiftright("slot", 1))
    dealt = placed.repartition(salted_parts(docs.sparkSession), "range").sortWithinPartitions("slot", "doc_id", "text").select("slot", "doc_id", "text")
    return dealt.mapInArrow(chained, FIELDS).withColumn("doc_id", F.nullif("doc_id", least))


def op9_one_permutation_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
