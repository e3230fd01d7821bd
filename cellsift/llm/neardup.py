"""Near-duplicate documents by DartMinHash signatures, banded joining and an exact check.

Exact copies are joined first; each distinct text goes on once, under a number of its own. Darts give it a
signature, bands of the signature give candidates, and word shingles decide: two texts are linked if the
Jaccard similarity of their five-word shingles is 0.8 or more. The darts' weights and the decision use the
same similarity: of shingle sets, or weighted by how often a text has a shingle. Classes are the connected
components of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import SALTS, map_rows, part_of, spread_join, table, texts, written
from .graph import components
from .shingles import mixed, shingled

BANDS, ROWS = 32, 5
THRESHOLD = 0.8
#: Members of a bucket that are held at a time, and others that are compared with them.
BLOCK, ASKING = 256, 1024
#: Sets whose darts are in memory together, a few thousand for each set however small it is.
SETS = 512
_FINE = 2.0**-6
_TALL = 256.0


def weighted(texts: list[str], counted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's index, shingle hash, weight) of the distinct shingles; weight: 1, or if counted, how often the text has it."""
    owner, hashes = shingled(texts)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])])) if len(owner) else np.zeros(0, int)
    count = np.diff(np.append(first, len(owner))).astype(float)
    return owner[first], hashes[first], count if counted else np.ones(len(first))


def members(texts: list[str], counted: bool = False) -> list[np.ndarray]:
    """For each text the sorted 32-bit hashes of a set; the sets' similarity is that of the weighted shingles.

    A shingle of whole weight w gives w elements, the first to the w-th of its kind: the Jaccard similarity of
    such sets is the weighted one, the sum of least weights by the sum of greatest.
    """
    owner, hashes, weight = weighted(texts, counted)
    w = weight.astype(np.int64)
    number = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
    owner, hashes = np.repeat(owner, w), np.repeat(hashes, w) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    return [np.unique(short[x:y]) for x, y in zip(cut, cut[1:], strict=False)]


def edges_of(level: int) -> tuple[float, float]:
    """Ranks that a level's cells span: doubling until cells are _TALL high, then all as high."""
    if level == 0:
        return 0.0, _FINE
    last = round(math.log2(_TALL / _FINE))
    if level <= last:
        return _FINE * 2.0 ** (level - 1), _FINE * 2.0**level
    return _TALL * (level - last), _TALL * (level - last + 1)


def poisson_table(rate: float) -> np.ndarray:
    n = np.arange(int(rate + 12 * math.sqrt(rate) + 24))
    return np.cumsum(np.exp(n * math.log(rate) - rate - np.array([math.lgamma(k + 1) for k in n])))


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k: for each set and coordinate the id of the earliest dart; 0 in rows of empty sets.

    Darts are thrown into the plane of weight and rank of each element by a Poisson process whose cells'
    contents follow from hashes, the same in all sets. A dart counts for a set if it lies below the set's
    weight of the element. owner is sorted. Each dart belongs to one of k coordinates; the earliest in rank is kept. Sets
    throw about k ln k + 2k darts, level by level, and go on while a coordinate is empty.
    """
    if n > SETS:
        cuts = [*range(0, n, SETS), n]
        at = np.searchsorted(owner, cuts)
        return np.concatenate([dart_signatures(owner[x:y] - a, element[x:y], weight[x:y], b - a, k) for a, b, x, y in zip(cuts, cuts[1:], at, at[1:], strict=False)])
    none = np.uint64(2**64 - 1)
    best = np.full(n * k, none)
    total = np.bincount(owner, weights=weight, minlength=n)
    wanted = (k * math.log(k) + 2 * k) / np.maximum(total, 1e-9)
    open_sets, level = total > 0, 0
    while open_sets.any():
        low, high = edges_of(level)
        table = poisson_table(high - low)
        live = open_sets[owner]
        own, elem, wt = owner[live], element[live], weight[live]
        column = 0
        while len(own):
            seed = elem + np.uint64(((level << 40) + (column << 20) + 1) * 0x9E3779B97F4A7C15 % 2**64)
            cell = mixed(seed)
            darts = np.searchsorted(table, (cell >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right")
            hit = np.flatnonzero(darts)
            of = np.repeat(hit, darts[hit])
            number = np.arange(len(of)) - np.repeat(np.cumsum(darts[hit]) - darts[hit], darts[hit])
            dart = mixed(cell[of] + (number + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
            inside = column + (dart & np.uint64(0xFFFF)).astype(np.float64) / 65536 < wt[of]
            of, dart = of[inside], dart[inside]
            rank = (low + (high - low) * (dart >> np.uint64(32)).astype(np.float64) * 2.0**-32).astype(np.float32)
            more = mixed(dart)
            coordinate = ((more >> np.uint64(40)) % np.uint64(k)).astype(np.int64)
            packed = rank.view(np.uint32).astype(np.uint64) << np.uint64(32) | (more & np.uint64(0xFFFFFFFF))
            np.minimum.at(best, own[of] * k + coordinate, packed)
            column += 1
            heavy = wt > column
            own, elem, wt = own[heavy], elem[heavy], wt[heavy]
        level += 1
        filled = (best.reshape(n, k) != none).all(axis=1)
        open_sets &= (wanted > high) | ~filled
    out = best.reshape(n, k)
    return np.where(out == none, np.uint64(0), out)


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    total = np.broadcast_to(np.arange(1, BANDS + 1).astype(np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        total = mixed(total + parts[:, :, i])
    return total.view(np.int64)


def text_key(text: str = "text") -> Column:
    """128 bits of a text; null as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def sketches(docs: DataFrame, counted: bool) -> DataFrame:
    """doc_id, text_key, part, bands; no bands for texts without words."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            raw = texts(batch)
            owner, element, weight = weighted(raw, counted)
            bands = band_hashes(dart_signatures(owner, element, weight, len(raw), BANDS * ROWS))
            some = np.bincount(owner, minlength=len(raw)) > 0
            return {x: batch.column(x) for x in ("doc_id", "text_key", "part")} | {"bands": [b if s else [] for b, s in zip(bands, some, strict=True)]}

        return step

    return map_rows(docs, make, "doc_id long, text_key binary, part int, bands array<long>", 2 << 20)


def shingle_sets(docs: DataFrame, counted: bool) -> DataFrame:
    """rep, words: members() of the text, as bytes."""

    def make():
        return lambda batch: {"rep": batch.column("rep"), "words": [w.tobytes() for w in members(texts(batch), counted)]}

    return map_rows(docs, make, "rep long, words binary", 2 << 20)


def linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar. A text may be the a of many pairs, the b of a few."""
    one = pairs.join(sets.select(F.col("rep").alias("b"), F.col("words").alias("wb")), "b")
    both = one.join(sets.select(F.col("rep").alias("a"), F.col("words").alias("wa")), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("wa"), batch.column("wb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y))
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    keep.append(False)
                    continue
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(same >= threshold * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "wa", "wb").mapInArrow(check, "a long, b long")


def candidates(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(band, rep) of the buckets with several texts, and the pairs (a, b), a < b, that are looked at first.

    A bucket is dealt to SALTS parts. Members meet the least one of their part, and those the least one of
    the bucket, so no task holds a large bucket and no text meets more than a part of it.
    """
    bands = first.select("rep", F.explode("bands").alias("band")).withColumn("part", part_of("rep"))
    own = Window.partitionBy("band", "part")
    dealt = written(bands.select("band", "rep", F.min("rep").over(own).alias("head"), F.max("rep").over(own).alias("last")), "parts")
    whole = Window.partitionBy("band")  # SALTS rows at most
    heads = dealt.where("rep = head").select("band", "rep", (F.col("head") < F.col("last")).alias("several"))
    tops = written(heads.select("*", F.min("rep").over(whole).alias("top"), F.max("rep").over(whole).alias("last")).where("several OR top < last"), "tops")
    others = dealt.where("head < rep")
    rows = others.select("band", "rep").union(tops.select("band", "rep"))
    pairs = others.select(F.col("head").alias("a"), F.col("rep").alias("b")).union(tops.where("top < rep").select(F.col("top").alias("a"), F.col("rep").alias("b")))
    return rows, pairs.distinct()


def with_roots(cand: DataFrame, forest: DataFrame) -> DataFrame:
    """band, rep, root of the buckets in which several roots are left."""
    rooted = cand.join(forest.select(F.col("node").alias("rep"), "root"), "rep", "left").select("band", "rep", F.coalesce("root", "rep").alias("root"))
    mixed_up = rooted.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("band")
    return spread_join(rooted, mixed_up, "band", part_of("rep"))


def compared(rooted: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between members of a bucket that lie in different components, all of them looked at.

    A bucket's members in its least component need not be compared with each other; all others are compared
    with every member. Members are dealt to blocks of about BLOCK, those others to blocks of about ASKING, and
    each block of the ones meets each of the others. A task holds two blocks, never a bucket, and gives one
    link for a member and component.
    """
    sizes = rooted.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("main")).select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n") / ASKING).cast("int").alias("turns"), "main")
    rows = spread_join(rooted, sizes, "band", part_of("rep")).join(sets, "rep")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")
    turn = F.pmod(F.xxhash64("rep", F.lit("turn")), F.col("turns")).cast("int").alias("turn")
    what = ["band", "block", "turn", "rep", "root", "words"]
    held = rows.select("*", own, F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn")).select(*what, F.lit(False).alias("asks"))
    asking = rows.where("root <> main").select("*", turn, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select(*what, F.lit(True).alias("asks"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        own, ask = pdf[~pdf["asks"]], pdf[pdf["asks"]]
        found = []
        if len(own) and len(ask):
            parts = [np.frombuffer(w, np.uint32) for w in own["words"]]
            size = np.array([len(p) for p in parts])
            flat = np.concatenate(parts)
            owner = np.repeat(np.arange(len(parts)), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            reps, roots = own["rep"].to_numpy(), own["root"].to_numpy()
            for rep, root, words in zip(ask["rep"], ask["root"], ask["words"], strict=True):
                mine = np.frombuffer(words, np.uint32)
                low, high = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
                n = high - low
                at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                same = np.bincount(owner[at], minlength=len(parts))
                ok = np.flatnonzero((same >= threshold * (size + len(mine) - same)) & (roots != root))
                if len(ok):
                    _, first = np.unique(roots[ok], return_index=True)
                    found += [(rep, reps[ok[i]]) for i in first]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return held.union(asking).groupBy("band", "block", "turn").applyInPandas(compare, "a long, b long")


def text_classes(docs: DataFrame, threshold: float, counted: bool) -> tuple[DataFrame, DataFrame]:
    """A row for each distinct text: text_key, n rows, least doc_id, class_id, class_key; and doc_id, text_key, part of each row."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))
    dealt = keyed.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    sketch = written(sketches(dealt, counted), "sketches")
    distinct = sketch.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    first = written(distinct.withColumn("rep", F.monotonically_increasing_id()), "texts")  # written, so that numbers stay
    cand, pairs = candidates(first)
    some = F.coalesce("doc_id", F.lit(0)).alias("some")  # of the rows with a text, those of one id are enough
    owners = first.join(cand.select("rep").distinct(), "rep", "left_semi").select("rep", "text_key", F.coalesce("least", F.lit(0)).alias("some"))
    source = keyed.select("text_key", some, "text").join(owners, ["text_key", "some"]).dropDuplicates(["text_key", "some"])
    sets = written(shingle_sets(source.select("rep", "text"), counted), "sets")
    forest = components(linked(pairs, sets, threshold))
    rooted = written(with_roots(cand, forest), "mixed")
    if not rooted.isEmpty():  # another leader of each bucket that has several components, then all that are left
        other = rooted.groupBy("band").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), "rep", "root")).alias("o")).select("band", F.col("o.rep").alias("a"), F.col("o.root").alias("aroot"))
        again = spread_join(rooted, other, "band", part_of("rep")).where("root <> aroot").select("a", F.col("rep").alias("b")).distinct()
        forest = components(linked(again, sets, threshold), forest)
        rooted = written(with_roots(rooted.drop("root"), forest), "mixed")
    if not rooted.isEmpty():
        forest = components(compared(rooted, sets, threshold), forest)
    found = first.select("rep", "text_key", "least", "n").join(forest.withColumnRenamed("node", "rep"), "rep", "left").drop("rep")
    alone = found.where("root IS NULL").select("text_key", "n", "least", F.col("least").alias("class_id"), F.col("text_key").alias("class_key"))
    tied = found.where("root IS NOT NULL")
    # of a class the least id that is not null, and the text that has it
    best = tied.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "text_key")).alias("best")).select("root", F.col("best.least").alias("class_id"), F.col("best.text_key").alias("class_key"))
    tied = spread_join(tied, best, "root", part_of("text_key")).select("text_key", "n", "least", "class_id", "class_key")
    return written(alone.union(tied), "classes"), sketch.select("doc_id", "text_key", "part")


def classes(docs: DataFrame, threshold: float = THRESHOLD, counted: bool = False) -> DataFrame:
    """doc_id, class_id, class_key: a row for each input row.

    Rows are copies if their texts are equal, whatever their ids; rows with equal or null ids and different
    texts stay apart. class_key tells classes apart: it is the 128-bit key of the text with the least doc_id.
    class_id is the least doc_id of the class, null where all are null. Null and empty texts are equal. Texts
    without words are only like equal ones; texts of fewer than five words are one shingle. counted: similarity
    and darts weigh a shingle as often as the text has it; else each weighs 1. Two texts at the threshold meet
    in some band with a probability of 0.999997; within a bucket of a band no pair of different components is
    left out, however large it is. Texts of any length are read whole. Extra columns are ignored, an empty
    table gives no rows.
    """
    known, rows = text_classes(docs, threshold, counted)
    single = known.where("n = 1").select(F.col("least").alias("doc_id"), "class_id", "class_key")
    copied = known.where("n > 1").select("text_key", "class_id", "class_key")
    return single.union(spread_join(rows, copied, "text_key", F.col("part")).select("doc_id", "class_id", "class_key"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, counted: bool = False) -> DataFrame:
    """One row of each class, its columns as they were, whatever their names: that of the least doc_id, nulls last.

    Of several texts with that id the one with the least key stays, of rows equal in id and text one. Rows
    with null or equal ids and different texts are different documents and all stay.
    """
    known, _ = text_classes(docs, threshold, counted)
    keep = known.where("text_key = class_key").select("text_key", F.coalesce("least", F.lit(0)).alias("id"), F.col("least").isNull().alias("unnamed"))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.struct("*").alias("row"), text_key().alias("text_key"), F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("unnamed"))
    keys = ["text_key", "id", "unnamed"]
    return rows.join(keep, keys, "left_semi").dropDuplicates(keys).select("row.*")


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
