"""A hierarchical Pitman-Yor language model over words.

Every context is a Chinese restaurant whose parent is the root restaurant; the root's base is uniform over
the known words and one unknown. The context of a word is the word before it. Contexts are told apart by
the leading bits of their words' hashes, as many as the corpus asks for. One word's seating depends on no
other word's given what all restaurants have together: up to 2^20 contexts that is a vector which every task
gets, beyond a table by context (spread_model.py), with the same results.

Texts go through in blocks. A block asks for each of its words once and gets the word's tables at the root
and its own shares in the contexts that it uses; tokens themselves are never joined. Dishes of one customer
have one table in any seating, so they are counted and need no answer.

A sweep draws the tables of all dishes from their conditional given the counts of the sweep before, then
the root's tables, then the strengths and discounts of both levels. Random numbers follow from word,
context and sweep, so the seating doesn't depend on how words are dealt to tasks, and can be drawn again.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import SALTS, file_bytes, halves, new_path, remainder, salted_parts, table, texts, written, written_by
from .shingles import mixed

#: Bits of a context's hash: a restaurant for so many bytes of text; contexts are 32-bit numbers.
LEAST_BITS, MOST_BITS, BYTES_A_CONTEXT = 8, 32, 512
#: Up to so many bits what restaurants have together is broadcast: 4 MB for each number of them.
BROADCAST_BITS = 20
#: Contexts whose sums are added up together.
RANGE = 1 << 13
BLOCK_BYTES = 12 << 20
#: Sweeps that are dropped, and samples that are averaged.
BURN_IN, SAMPLES = 2, 4
#: Up to so many customers a dish's seating is drawn from the table of Stirling numbers.
EXACT = 64
#: Documents, about, from which the words that many tasks have to share are told; results don't depend on them.
SHARED_DOCS = 2000
#: Values that strengths and discounts are drawn from.
STRENGTHS = (0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0, 10_000.0)
DISCOUNTS = tuple(x / 20 for x in range(2, 20))


# ---------------------------------------------------------------- reading texts


def lower(text: str) -> list[bytes]:
    """Words; A-Z in lower case."""
    return text.encode().lower().split()


def hash_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def context_bits(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(1 + size / BYTES_A_CONTEXT))))


def shared_words(docs: DataFrame) -> dict[int, int]:
    """By hash, into how many parts a word's contexts are dealt: no part has much more than a quarter of a task's share.

    At most 4 words for each task, counted in a sample. A word's parts change where it is counted, not its counts.
    """
    n, tasks = docs.count(), salted_parts(docs.sparkSession)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("shared")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = docs.where(draw < min(1.0, SHARED_DOCS / max(1, n))).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in texts(batch):
                seen.update([*lower(t), b""])
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    counts = picked.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    whole = counts.agg(F.sum("n")).first()[0] or 0
    least = whole / (4 * tasks)
    return {hash_of(bytes(r.word)): math.ceil(r.n / least) for r in counts.where(F.col("n") > least).collect()}


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one compressed string; bytes of equal weight stand together."""
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), a.itemsize)]], np.int64)
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if len(a) else b"" for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + body)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for size, item in head.tolist():
        part = np.frombuffer(raw, np.uint8, size * item, at).reshape(item, size).T
        out.append(np.ascontiguousarray(part).view(f"<u{item}").ravel())
        at += size * item
    return out


def read_blocks(docs: DataFrame, path: str, bits: int, shared: dict[int, int], buckets: int = 0) -> DataFrame:
    """Writes and gives blocks (block, data, words), in buckets by block where a number of them is given.

    A block's data are its documents' ids, whether they are null and held out, their numbers of tokens, the
    tokens as numbers of the block's words, the words' contexts, and which words are shared by how many parts;
    words: their hashes. Word 0 is the end.
    """
    given = docs.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get(), 0
        for whole in batches:
            for batch in halves(whole, BLOCK_BYTES):
                block = (task.partitionId() if task else 0) << 32 | number
                number += 1
                yield one(batch, block)

    def one(batch: pa.RecordBatch, block: int) -> pa.RecordBatch:
        index: dict[bytes, int] = {b"": 0}
        tokens: list[np.ndarray] = []
        sizes = np.empty(batch.num_rows, np.uint32)
        for i, t in enumerate(texts(batch)):
            words = lower(t)
            sizes[i] = len(words) + 1
            tokens.append(np.array([*[index.setdefault(w, len(index)) for w in words], 0], np.uint32))
        held = np.array(batch.column("held_out").to_pylist(), np.uint8)
        ids = batch.column("doc_id")
        null = np.array(ids.is_null().to_pylist(), np.uint8)
        words = np.fromiter(map(hash_of, index), np.uint64, len(index))
        of_many = np.flatnonzero(np.isin(words, np.fromiter(given.value, np.uint64, len(given.value)))).astype(np.uint32)
        parts = np.array([given.value[int(words[i])] for i in of_many], np.uint32)
        kinds = (words >> np.uint64(64 - bits)).astype(np.uint32)
        data = packed([ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null, held, sizes, np.concatenate(tokens), kinds, of_many, parts])
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([data], pa.binary()), pa.array([words.tobytes()], pa.binary())], names=["block", "data", "words"])

    shape = "block long, data binary, words binary"
    blocks = docs.select("doc_id", "held_out", "text").mapInArrow(run, shape)
    if buckets:
        return written_by(blocks, "blocks", "block", buckets, path)
    blocks.write.parquet(path)
    return docs.sparkSession.read.schema(shape).parquet(path)


@dataclass
class Pairs:
    """The pairs of word and context that a block has, by word, part and context."""

    word: np.ndarray
    part: np.ndarray
    context: np.ndarray
    trained: np.ndarray  # how often in training texts
    of: np.ndarray  # the pair of each token


def pairs_of(held: np.ndarray, sizes: np.ndarray, j: np.ndarray, kinds: np.ndarray, of_many: np.ndarray, shared: np.ndarray, bits: int) -> Pairs:
    kinds, parts = kinds.astype(np.int64), np.ones(len(kinds), np.int64)
    parts[of_many] = shared
    j = j.astype(np.int64)
    before = np.concatenate([[0], j[:-1]])  # each text follows an end
    key, of = np.unique(j << bits | kinds[before], return_inverse=True)
    word, context = key >> bits, key & ((1 << bits) - 1)
    part = context % parts[word]
    trained = np.bincount(of, weights=np.repeat(held == 0, sizes), minlength=len(key)).astype(np.uint32)
    order = np.arange(len(key))
    several = np.flatnonzero(parts[word] > 1)
    order[several] = several[np.lexsort((context[several], part[several], word[several]))]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Pairs(word[order], part[order], context[order], trained[order], place[of])


WORDS = "dest int, data binary"


def deltas(values: np.ndarray) -> np.ndarray:
    """Differences, which np.cumsum(..., dtype=np.uint32) undoes."""
    return np.diff(values.astype(np.uint32), prepend=np.uint32(0))


def slices(cuts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places from cuts[i] to cuts[i + 1] for each i of rows."""
    m = np.diff(cuts)[rows]
    return np.repeat(cuts[:-1][rows] - (np.cumsum(m) - m), m) + np.arange(m.sum())


def groups_of(blocks: DataFrame) -> int:
    """Into how many groups words are dealt: two a task, or of about 16 MB of text, which are 8 MB of blocks."""
    return max(2 * salted_parts(blocks.sparkSession), file_bytes(blocks) >> 23)


def word_rows(blocks: DataFrame, bits: int) -> DataFrame:
    """What each block has of the words of each of some groups (dest): one row, so rows don't grow with the words.

    data: the block; the words' hashes, parts (0: the only one), places of their first pairs and numbers of
    pairs; the pairs' contexts, and how often in training texts.
    """
    groups = groups_of(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, words in zip(*(batch.column(c).to_pylist() for c in ("block", "data", "words")), strict=True):
                _, _, *rest = unpacked(data)
                yield from one(block, pairs_of(*rest, bits), np.frombuffer(words, np.uint64), rest[4])

    def one(block: int, p: Pairs, words: np.ndarray, of_many: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate([[True], (p.word[1:] != p.word[:-1]) | (p.part[1:] != p.part[:-1])]))
        cuts = np.append(first, len(p.word))
        word, part = words[p.word[first]], np.where(np.isin(p.word[first], of_many), p.part[first] + 1, 0).astype(np.uint32)
        dest = (mixed(word + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(dest, kind="stable")
        at = slices(cuts, order)
        word, part, start, m = word[order], part[order], first[order], np.diff(cuts)[order]
        context, trained = p.context[at].astype(np.uint32), p.trained[at]
        ends = np.concatenate([[0], np.cumsum(m)])
        found, begin = np.unique(dest[order], return_index=True)
        out = []
        for x, y in zip(begin, np.append(begin[1:], len(order)), strict=True):
            some = slice(ends[x], ends[y])
            out.append(packed([np.array([block], np.uint64), word[x:y], part[x:y], deltas(start[x:y]), m[x:y].astype(np.uint32), context[some], trained[some]]))
        for a in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(found[a : a + 256].astype(np.int32)), pa.array(out[a : a + 256], pa.binary())], names=["dest", "data"])

    return blocks.mapInArrow(run, WORDS)


# ---------------------------------------------------------------- words of all blocks


MERGED = "row long, word binary, split binary, count binary, big binary, ctx binary, n binary, asks binary"


def summed(dest: int, data: list[bytes], bits: int) -> pa.Table:
    """One row for a group of words; each column has what packed() makes of its arrays.

    By word: its hash; whether it has several parts; count: its training tokens; big: the customers of its
    dishes of two customers or more. ctx, n: how many such dishes each word has, their contexts and customers.
    asks: the blocks, how many words each asks for and which, the places of their first pairs, how many pairs of
    such dishes or of dishes whose only customer is another block's, those pairs (from the first one on),
    and their dishes (from the word's first, 1 on; 0: another block's).
    """
    given = [unpacked(d) for d in data]
    word, part, m, ctx, n = (np.concatenate([g[i] for g in given]) for i in (1, 2, 4, 5, 6))
    order = np.lexsort((part, word))
    new = np.concatenate([[True], (np.diff(word[order]) != 0) | (np.diff(part[order]) != 0)])
    first, group = order[new], np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    cuts = np.concatenate([[0], np.cumsum(m.astype(np.int64))])
    row = np.repeat(np.arange(len(word)), m)
    key, dish = np.unique(group[row] << bits | ctx.astype(np.int64), return_inverse=True)
    total = np.bincount(dish, weights=n, minlength=len(key))
    count = np.bincount(group[row], weights=n, minlength=len(first))
    large = total > 1
    number = np.cumsum(large) - 1  # of the large dishes
    key, sums = key[large], total[large]
    at = np.searchsorted(key >> bits, np.arange(len(first) + 1))
    big = np.bincount(key >> bits, weights=sums, minlength=len(first))
    asked = large[dish] | (total == 1)[dish] & (n == 0)  # the latter's customer is another block's
    pair = (np.arange(len(row)) - cuts[row])[asked]
    place = np.where(large[dish[asked]], number[dish[asked]] - at[group[row[asked]]] + 1, 0)
    asks = [np.concatenate([g[0] for g in given]), np.array([len(g[1]) for g in given], np.uint64), deltas(group), np.concatenate([g[3] for g in given])]
    asks += [x.astype(np.uint32) for x in (np.bincount(row[asked], minlength=len(word)), pair, place)]
    columns = [[word[first]], [(part[first] > 0).astype(np.uint8)], [count.astype(np.uint64)], [big.astype(np.uint64)], [np.diff(at).astype(np.uint32), (key & ((1 << bits) - 1)).astype(np.uint32)], [sums.astype(np.uint64)], asks]
    names = ["row", "word", "split", "count", "big", "ctx", "n", "asks"]
    return pa.table([pa.array([dest], pa.int64()), *[pa.array([packed(c)], pa.binary()) for c in columns]], names=names)


def merged(words: DataFrame, bits: int) -> DataFrame:
    def merge(group: pa.Table) -> pa.Table:
        return summed(group.column("dest")[0].as_py(), group.column("data").to_pylist(), bits)

    return words.groupBy("dest").applyInArrow(merge, MERGED)


# ---------------------------------------------------------------- seating


@dataclass
class Totals:
    """What all words' restaurants have together before a sweep."""

    kinds: int
    customers: np.ndarray  # by context
    tables: np.ndarray  # by context
    root_customers: float
    root_tables: float
    discount: float
    root_discount: float
    strength: float = 1.0
    root_strength: float = 1.0
    shared: dict[int, tuple[float, float]] = field(default_factory=dict)  # of words in several parts, customers and tables at the root

    @property
    def unseen(self) -> float:
        """The root's probability of a word without customers, each of the kinds and the unknown word alike."""
        return (self.root_strength + self.root_discount * self.root_tables) / (self.root_strength + self.root_customers) / (self.kinds + 1)

    def at_root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Words' probabilities at the root; over all words and the unknown one they sum up to 1."""
        return np.maximum(customers - self.root_discount * tables, 0) / (self.root_strength + self.root_customers) + self.unseen

    def opening(self) -> np.ndarray:
        return self.strength + self.discount * self.tables

    def passed_on(self) -> np.ndarray:
        """By context, the weight of the root; with the words' own shares it sums up to 1."""
        return self.opening() / (self.strength + self.customers)


def log_stirling(discount: float) -> np.ndarray:
    """log S(c, t) of the generalised Stirling numbers: S(c + 1, t) = S(c, t - 1) + (c - discount * t) S(c, t)."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0
    for c in range(1, EXACT):
        t = np.arange(1, c + 2)
        stay = np.where(c - discount * t > 0, np.log(np.maximum(c - discount * t, 1e-300)) + out[c, 1 : c + 2], -np.inf)
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, 0 : c + 1], stay)
    return out


def uniform(key: np.ndarray, number: int) -> np.ndarray:
    """The number-th random number in (0, 1) of each key, the same wherever it is drawn."""
    return ((mixed(key + np.uint64(number * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def binomial(size: np.ndarray, chance: np.ndarray, key: np.ndarray, number: int) -> np.ndarray:
    """Binomial counts: by inversion where less than 30 are expected, else rounded from the normal law."""
    mean = size * chance
    u = uniform(key, 2 * number)
    out = (u < chance).astype(float)
    few = np.flatnonzero((size > 1) & (mean <= 30))
    if len(few):
        n, p, left = size[few], np.minimum(chance[few], 1 - 1e-12), u[few]
        mass = np.exp(n * np.log1p(-p))
        got, k = np.zeros(len(few)), 0
        left = left - mass
        while (left > 0).any() and k < 200:
            k += 1
            got += left > 0
            mass = mass * np.maximum(n - k + 1, 0) / k * p / (1 - p)
            left = left - mass
        out[few] = np.minimum(got, n)
    many = np.flatnonzero((size > 1) & (mean > 30))
    if len(many):
        normal = np.sqrt(-2 * np.log(u[many])) * np.cos(2 * np.pi * uniform(key[many], 2 * number + 1))
        out[many] = np.clip(np.rint(mean[many] + normal * np.sqrt(mean[many] * (1 - chance[many]))), 0, size[many])
    return out


def seat(customers: np.ndarray, opening: np.ndarray, discount: float, stirling: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Tables of each dish, its customers seated anew given all other dishes.

    opening: the weight of a new table against c - discount * t of the t tables there are. Up to EXACT customers
    the number of tables is drawn from its conditional, S(c, t) * opening ** t. Larger parties come in
    one by one up to EXACT, then in groups of 5 percent of those who sit: the law of arrivals, which is not
    the conditional. The sweeps use reseat(). key: each dish's source of random numbers.
    """
    tables = np.ones(len(customers))
    few = np.flatnonzero((customers > 1) & (customers <= EXACT))
    size = customers[few].astype(np.int64)
    order = np.argsort(size, kind="stable")
    few, size = few[order], size[order]
    cuts = np.searchsorted(size, np.arange(2, EXACT + 2))
    for c, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), 2):
        for x in range(a, b, 100_000):
            rows = few[x : min(b, x + 100_000)]
            weight = stirling[c, 1 : c + 1] + np.log(opening[rows])[:, None] * np.arange(1, c + 1)
            share = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[rows] = 1 + (share < (uniform(key[rows], 0) * share[:, -1])[:, None]).sum(axis=1)
    rows = np.flatnonzero(customers > EXACT)
    sitting, number = np.ones(len(rows)), 0
    while len(rows):
        number += 1
        size = np.minimum(np.maximum(1, np.floor(sitting * 0.05)), customers[rows] - sitting)
        middle = sitting + (size - 1) / 2
        chance = opening[rows] / (middle - discount * tables[rows] + opening[rows])
        tables[rows] += binomial(size, np.clip(chance, 0, 1), key[rows], number)
        sitting += size
        go = sitting < customers[rows]
        rows, sitting = rows[go], sitting[go]
    return tables


def party_moments(customers: np.ndarray, opening: np.ndarray, discount: float, points: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of t under S(c, t) * opening ** t, for c beyond EXACT.

    The sum over t is c! times the coefficient of z ** c in exp(opening * (1 - (1 - z) ** d) / d). With z = exp(s) its
    contour is a parabola around the cut s > 0, through the saddle or, for few tables, near the cut's end.
    """
    c, rate = customers[:, None], (opening / discount)[:, None]
    low, high = np.log(1e-3 / customers), np.full(len(customers), 4.0)
    for _ in range(30):  # the saddle, at s = -sigma
        at = (low + high) / 2
        sigma = np.exp(at)
        beyond = np.log(opening / customers) - sigma + (discount - 1) * np.log(-np.expm1(-sigma)) > 0
        low, high = np.where(beyond, at, low), np.where(beyond, high, at)
    sigma = np.maximum(sigma, 6 / customers)
    bend = customers + opening * (1 - discount) * np.exp(-2 * sigma) * (-np.expm1(-sigma)) ** (discount - 2)
    reach = np.minimum(np.minimum(8 / (2 * sigma * np.sqrt(bend)), np.sqrt(40 / (customers * sigma)) * 1.6), np.pi / (2 * sigma))
    sigma = sigma[:, None]
    turn = 1 + 1j * reach[:, None] * ((np.arange(points) + 0.5) / points)
    s = -sigma * turn**2
    y = rate * (-np.expm1(s)) ** discount
    top = c * sigma - y[:, :1].real
    weight = turn * np.exp(-y - c * s - top)
    # the constant has no such coefficient; without it small y lose no digits
    small = y[:, 0].real < 1
    whole = np.where(small[:, None], turn * np.expm1(-np.where(small[:, None], y, 0)) * np.exp(-c * s - np.where(small[:, None], top, c * sigma)), weight)
    a, b, e = (x.real.sum(axis=1) for x in (whole, -y * weight, y * y * weight))
    mean = rate[:, 0] + b / a
    return mean, mean + e / a - (b / a) ** 2


def matched(mean: np.ndarray, variance: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Counts of such mean and variance: binomial, Poisson or negative binomial, by inversion up to a mean of 30, else normal with their skewness."""
    out = np.zeros(len(mean))
    variance = np.maximum(variance, 1e-3 * mean)
    few = np.flatnonzero((mean > 0) & (mean <= 30))
    m, v = mean[few], variance[few]
    ratio = np.where(np.abs(v / m - 1) < 1e-6, 1 + 1e-6, v / m)
    mass = np.exp(m * np.log(ratio) / (1 - ratio))
    left, a, k = uniform(key[few], 0) - mass, 1 - 1 / ratio, 0
    b = m / ratio - a
    while (left > 0).any() and k < 400:
        k += 1
        out[few] += left > 0
        mass = mass * np.maximum(a + b / k, 0)
        left = left - np.where(mass > 0, mass, np.inf)
    many = np.flatnonzero(mean > 30)
    m, v = mean[many], variance[many]
    normal = np.sqrt(-2 * np.log(uniform(key[many], 0))) * np.cos(2 * np.pi * uniform(key[many], 1))
    out[many] = np.maximum(np.rint(m + np.sqrt(v) * normal + (2 * v / m - 1) * (normal**2 - 1) / 6), 0)
    return out


def reseat(customers: np.ndarray, opening: np.ndarray, discount: float, stirling: np.ndarray, key: np.ndarray) -> np.ndarray:
    """As seat(), every dish from its conditional S(c, t) * opening ** t, parties beyond EXACT too.

    For those, tables beyond the first, or customers beyond one a table where most have a table of their own,
    are drawn from the law that has the conditional's mean and variance; as the parties grow the two laws meet.
    """
    tables = np.ones(len(customers))
    few = customers <= EXACT
    tables[few] = seat(customers[few], opening[few], discount, stirling, key[few])
    large = np.flatnonzero(~few)
    for x in range(0, len(large), 4000):
        rows = large[x : x + 4000]
        c = customers[rows].astype(float)
        mean, variance = party_moments(c, opening[rows], discount)
        most = mean > 0.75 * c
        got = matched(np.where(most, c - mean, mean - 1), variance, key[rows])
        tables[rows] = np.clip(np.where(most, c - got, 1 + got), 1, c)
    return tables


@dataclass
class Dishes:
    """Some words' dishes of two customers or more, and how many of one customer each word has."""

    word: np.ndarray
    ctx: np.ndarray
    n: np.ndarray
    cuts: np.ndarray
    count: np.ndarray  # of each word's training tokens
    single: np.ndarray
    split: np.ndarray
    tables: list[np.ndarray] | None = None  # of each dish's context before each sweep; None: the totals have them

    @staticmethod
    def of_batch(batch: pa.RecordBatch) -> Dishes:
        word, split, count, big, n = (joined([unpacked(x)[0] for x in batch.column(c).to_pylist()]) for c in ("word", "split", "count", "big", "n"))
        given = [unpacked(x) for x in batch.column("ctx").to_pylist()]
        cuts = np.concatenate([[0], np.cumsum(joined([m for m, _ in given]).astype(np.int64))])
        tables = [joined([told(ctx, x) for (_, ctx), x in zip(given, batch.column(c).to_pylist(), strict=True)]) for c in batch.schema.names if c.startswith("tables_")]
        return Dishes(word.astype(np.uint64), joined([c for _, c in given]).astype(np.uint32), n.astype(float), cuts, count.astype(float), (count - big).astype(float), split.astype(bool), tables or None)


def joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)


def told(contexts: np.ndarray, answer: bytes | None) -> np.ndarray:
    """The tables of each of the contexts; answer has the different ones, in order, and their tables."""
    if answer is None:
        return np.zeros(len(contexts), np.float32)
    known, tables = unpacked(answer)
    return tables.astype(np.float32)[np.searchsorted(known, contexts)]


def root_seats(word: np.ndarray, customers: np.ndarray, before: Totals, sweep: int, stirling: np.ndarray) -> np.ndarray:
    """Tables at the root, drawn from their conditional."""
    tables = np.minimum(customers, 1.0)
    many = np.flatnonzero(customers > 1)
    weight = np.full(len(many), before.unseen * (before.root_strength + before.root_customers))
    tables[many] = reseat(customers[many], weight, before.root_discount, stirling, mixed(mixed(word[many]) + np.uint64(sweep)))
    return tables


def sweeps(d: Dishes, chain: list[Totals], samples: int, stirling: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tables by dish, customers and tables at the root by word) after the sweeps given each of chain, the last one `samples` times.

    Of words in several parts, the customers are those of this part, and the tables mean nothing.
    """
    of = np.repeat(np.arange(len(d.word)), np.diff(d.cuts))
    keys = mixed(mixed(d.word)[of] + d.ctx.astype(np.uint64) + np.uint64(1))
    customers = d.single + np.diff(d.cuts)
    tables = np.minimum(customers, 1.0)
    out = []
    for p, (before, table) in enumerate(zip(chain, stirling, strict=True)):
        for i in np.flatnonzero(d.split):
            customers[i], tables[i] = before.shared[int(d.word[i])]
        opened = before.opening()[d.ctx] if d.tables is None else before.strength + before.discount * d.tables[p]
        opening = opened * before.at_root(customers, tables)[of]
        for s in range(samples if p == len(chain) - 1 else 1):
            sweep = 64 * p + s
            t = reseat(d.n, opening, before.discount, table[0], mixed(keys + np.uint64(sweep)))
            guests = d.single + np.bincount(of, weights=t, minlength=len(d.word))
            out.append((t, guests, root_seats(d.word, guests, before, sweep, table[1])))
        customers, tables = out[-1][1].copy(), out[-1][2].copy()
    return out[len(chain) - 1 :]


def light(chain: list[Totals]) -> list[Totals]:
    """What sweeps() needs of them."""
    return [replace(t, customers=np.zeros(0), tables=t.tables.astype(np.float32)) for t in chain]


def stirlings(chain: list[Totals]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(log_stirling(t.discount), log_stirling(t.root_discount)) for t in chain]


def party_counts(customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """How many dishes have so many customers and tables, up to EXACT; of larger ones their number, log customers and tables beyond one."""
    few = customers <= EXACT
    wide = EXACT + 1
    small = np.bincount(customers[few].astype(np.int64) * wide + tables[few].astype(np.int64), minlength=wide * wide)
    return np.concatenate([small, [(~few).sum(), np.log(customers[~few]).sum(), (tables[~few] - 1).sum()]])


PARTY = (EXACT + 1) ** 2 + 3
SUMS = "k long, data binary"


def reduced(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sums by k of arrays by index; the data are (index, one array of values after the other)."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        index, total = np.zeros(0, np.uint64), None
        for data in pdf["data"]:
            more, *values = unpacked(data)
            values = np.array([v.view(np.float64) for v in values])
            if total is None:
                index, total = more, values
                continue
            both, place = np.unique(np.concatenate([index, more]), return_inverse=True)
            index, total = both, np.array([np.bincount(place, weights=np.concatenate(x), minlength=len(both)) for x in zip(total, values, strict=True)])
        return pd.DataFrame({"k": pdf["k"][:1], "data": [packed([index, *total])]})

    some = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALTS))).groupBy("k", "part").applyInPandas(add, SUMS)
    return {r.k: unpacked(r.data) for r in some.groupBy("k").applyInPandas(add, SUMS).collect()}


def sums_rows(arrays: list[np.ndarray], rest: np.ndarray, shared: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Rows for reduced(): sums by context in ranges, where there are any; k -1: others; k -2: of words in several parts."""
    keys, data = [-1], [packed([np.arange(len(rest), dtype=np.uint64), rest])]
    if shared:
        keys.append(-2)
        data.append(packed([np.array(list(shared), np.uint64), *np.array(list(shared.values()), float).T.copy()]))
    for k in range(0, len(arrays[0]), RANGE):
        some = np.flatnonzero(np.any([a[k : k + RANGE] != 0 for a in arrays], axis=0))
        if len(some):
            keys.append(k // RANGE)
            data.append(packed([some.astype(np.uint64), *[a[k : k + RANGE][some] for a in arrays]]))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], names=["k", "data"])


def dense(got: dict[int, list[np.ndarray]], number: int, bits: int) -> np.ndarray:
    out = np.zeros((number, 1 << bits))
    for k, (index, *values) in got.items():
        if k >= 0:
            out[:, k * RANGE + index.astype(np.int64)] = [v.view(np.float64) for v in values]
    return out


def listed(got: dict[int, list[np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values (one row for each array) of k."""
    if k not in got:
        return np.zeros(0, np.uint64), np.zeros((0, 0))
    index, *values = got[k]
    return index, np.array([v.view(np.float64) for v in values])


#: Columns of MERGED that Dishes are made of.
DISHES = ("word", "split", "count", "big", "ctx", "n")


def begun(words: DataFrame, bits: int) -> tuple[Totals, dict[int, int], np.ndarray]:
    """The totals when every dish has one table; counts of words in several parts; tables of dishes of one customer by context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, rest, shared = np.zeros((3, 1 << bits)), np.zeros(6), {}
        for batch in together(batches):
            d = Dishes.of_batch(batch)
            arrays[0] += np.bincount((d.word >> np.uint64(64 - bits)).astype(np.int64), weights=d.count, minlength=1 << bits)
            arrays[1] += np.bincount(d.ctx, weights=d.n, minlength=1 << bits)
            arrays[2] += np.bincount(d.ctx, minlength=1 << bits)
            rest += first_counts(d, shared)
        yield sums_rows(list(arrays), rest, shared)

    got = reduced(words.select(*DISHES).mapInArrow(run, SUMS))
    customers, large, dishes = dense(got, 3, bits)
    single = customers - large
    return *first_totals(got, customers, single + dishes), single


def first_counts(d: Dishes, shared: dict[int, np.ndarray]) -> np.ndarray:
    """Numbers of words, of their dishes and of dishes with one and two customers; words in several parts go to shared."""
    c = d.single + np.diff(d.cuts)
    own = ~d.split
    for i in np.flatnonzero(d.split):
        w = int(d.word[i])
        shared[w] = shared.get(w, np.zeros(2)) + [c[i], d.count[i]]
    return np.array([(c[own] > 0).sum(), c[own].sum(), d.single.sum(), (d.n == 2).sum(), (c[own] == 1).sum(), (c[own] == 2).sum()], float)


def first_totals(got: dict[int, list[np.ndarray]], customers: np.ndarray, tables: np.ndarray) -> tuple[Totals, dict[int, int]]:
    _, rest = listed(got, -1)
    rest = rest[0] if len(rest) else np.zeros(6)
    index, values = listed(got, -2)
    shared = {int(w): (c, min(c, 1.0)) for w, c in zip(index, values[0] if len(values) else [], strict=True)}
    counts = {int(w): int(n) for w, n in zip(index, values[1] if len(values) else [], strict=True)}
    own = np.array([c for c, _ in shared.values()])
    kinds, guests, one, two = rest[0] + (own > 0).sum(), rest[1] + own.sum(), rest[4] + (own == 1).sum(), rest[5] + (own == 2).sum()
    # the usual estimate from how many dishes have one and two customers
    d, e = (float(np.clip(x / max(1.0, x + 2 * y), 0.1, 0.95)) for x, y in ((rest[2], rest[3]), (one, two)))
    return Totals(int(kinds), customers, tables, float(guests), float(kinds), d, e, shared=shared), counts


def swept(words: DataFrame, chain: list[Totals], single: np.ndarray, bits: int, samples: int = 1) -> tuple[list[Totals], list[np.ndarray]]:
    """The totals after each of the samples, and the counts of parties of contexts and root after the first."""
    given = words.sparkSession.sparkContext.broadcast(light(chain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stirling = stirlings(given.value)
        arrays, rest, shared = np.zeros((samples, 1 << bits)), np.zeros(2 * samples + 2 * PARTY), {}
        for batch in together(batches):
            d = Dishes.of_batch(batch)
            got = sweeps(d, given.value, samples, stirling)
            for s, (t, _, _) in enumerate(got):
                arrays[s] += np.bincount(d.ctx, weights=t, minlength=1 << bits)
            rest += sweep_counts(d, got, shared)
        yield sums_rows(list(arrays), rest, shared)

    got = reduced(words.select(*DISHES).mapInArrow(run, SUMS))
    out, parties = swept_totals(got, chain, samples)
    parties[0][EXACT + 2] += single.sum()  # one customer, one table
    return [replace(t, tables=single + x) for t, x in zip(out, dense(got, samples, bits), strict=True)], parties


def sweep_counts(d: Dishes, got: list[tuple[np.ndarray, np.ndarray, np.ndarray]], shared: dict[int, np.ndarray]) -> np.ndarray:
    """Customers and tables at the root by sample, and the first one's parties; words in several parts go to shared."""
    own, samples = ~d.split, len(got)
    rest = np.zeros(2 * samples + 2 * PARTY)
    for s, (t, c, r) in enumerate(got):
        rest[2 * s : 2 * s + 2] = c[own].sum(), r[own].sum()
        if not s:
            rest[2 * samples :] = np.concatenate([party_counts(d.n, t), party_counts(c[own], r[own])])
        for i in np.flatnonzero(d.split):
            w = int(d.word[i])
            shared.setdefault(w, np.zeros(samples))[s] += c[i]
    return rest


def swept_totals(got: dict[int, list[np.ndarray]], chain: list[Totals], samples: int) -> tuple[list[Totals], list[np.ndarray]]:
    """swept(), but for the contexts' tables and the parties of one customer."""
    _, rest = listed(got, -1)
    rest = rest[0] if len(rest) else np.zeros(2 * samples + 2 * PARTY)
    index, values = listed(got, -2)
    before, parties = chain[-1], [rest[2 * samples : 2 * samples + PARTY].copy(), rest[2 * samples + PARTY :].copy()]
    out = []
    for s in range(samples):
        c = values[s] if len(values) else np.zeros(0)
        r = root_seats(index, c, before, 64 * (len(chain) - 1) + s, log_stirling(before.root_discount))
        if not s:
            parties[1] += party_counts(c, r)
        shared = {int(w): (float(x), float(y)) for w, x, y in zip(index, c, r, strict=True)}
        out.append(replace(before, root_customers=float(rest[2 * s] + c.sum()), root_tables=float(rest[2 * s + 1] + r.sum()), shared=shared))
    return out, parties


# ---------------------------------------------------------------- strengths and discounts


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, eight above."""
    x = np.asarray(x, float)
    shift = np.log(np.prod([x + i for i in range(8)], axis=0)) if x.size else x
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def likelihoods(customers: np.ndarray, tables: np.ndarray, parties: np.ndarray) -> np.ndarray:
    """For each of DISCOUNTS and STRENGTHS the log probability of the seating of some restaurants."""
    return restaurants(customers, tables) + dishes_seated(parties)[:, None]


def restaurants(customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The part of (strength | discount) over tables by (strength | 1) over customers."""
    t, nt = np.unique(tables[customers > 0], return_counts=True)
    c, nc = np.unique(customers[customers > 0], return_counts=True)
    out = np.zeros((len(DISCOUNTS), len(STRENGTHS)))
    for i, d in enumerate(DISCOUNTS):
        for k, strength in enumerate(STRENGTHS):
            opened = (t - 1) * math.log(d) + log_gamma(strength / d + t) - math.lgamma(strength / d + 1)
            came = log_gamma(strength + c) - math.lgamma(strength + 1)
            out[i, k] = (nt * opened).sum() - (nc * came).sum()
    return out


def dishes_seated(parties: np.ndarray) -> np.ndarray:
    """The dishes' part by discount: Stirling numbers of customers and tables; beyond EXACT customers their limit for many customers."""
    small, (number, logs, beyond) = parties[:-3].reshape(EXACT + 1, EXACT + 1).copy(), parties[-3:]
    small[0] = 0
    seen = small > 0
    return np.array([(small[seen] * log_stirling(d)[seen]).sum() - number * math.lgamma(1 - d) - d * logs - beyond * math.log(d) for d in DISCOUNTS])


def drawn(logs: np.ndarray, sweep: int) -> tuple[float, float]:
    """A discount and strength with these log probabilities."""
    share = np.cumsum(np.exp(logs - logs.max()))
    i = int((share < float(uniform(np.array([0], np.uint64), 1000 + sweep)[0]) * share[-1]).sum())
    return DISCOUNTS[i // len(STRENGTHS)], STRENGTHS[i % len(STRENGTHS)]


def fitted(after: Totals, parties: list[np.ndarray], sweep: int, seated: np.ndarray | None = None) -> Totals:
    """The totals with strengths and discounts drawn given the seating; seated: restaurants() of all contexts, if they are at hand."""
    if not after.kinds:
        return after
    seated = restaurants(after.customers, after.tables) if seated is None else seated
    d, strength = drawn(seated + dishes_seated(parties[0])[:, None], 2 * sweep)
    e, root = drawn(likelihoods(np.array([after.root_customers]), np.array([after.root_tables]), parties[1]), 2 * sweep + 1)
    return replace(after, discount=d, strength=strength, root_discount=e, root_strength=root)


def together(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Rows joined up to about so many bytes, which are packed."""
    held: list[pa.RecordBatch] = []
    for batch in (part for whole in batches for part in halves(whole, most)):
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# ---------------------------------------------------------------- scores


ANSWERS = "block long, kind int, data binary"


def starts_of(asks: list[np.ndarray]) -> list[np.ndarray]:
    """The places of words' first pairs, by block."""
    return [np.cumsum(part, dtype=np.uint32) for part in np.split(asks[3], np.cumsum(asks[1].astype(np.int64))[:-1])]


def answers(words: DataFrame, chain: list[Totals], finals: list[Totals], counts: dict[int, int]) -> DataFrame:
    """block, kind 0, data: by the place of a word's first pair its count, and its customers and tables at the root by sample; of the pairs (m a word) that have several customers, or another block's one, the customers and the tables of all samples."""
    given = words.sparkSession.sparkContext.broadcast((light(chain), [t.shared for t in finals], counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, shared, counts = given.value
        stirling = stirlings(chain)
        for batch in together(batches):
            d = Dishes.of_batch(batch)
            got = sweeps(d, chain, len(shared), stirling)
            seated = np.sum([t for t, _, _ in got], axis=0).astype(np.uint64)
            count = d.count.astype(np.uint64)
            root = np.array([x for _, c, r in got for x in (c, r)])
            for i in np.flatnonzero(d.split):
                w = int(d.word[i])
                count[i] = counts[w]
                root[:, i] = [x for known in shared for x in known[w]]
            root = root.astype(np.uint64)
            asks = [unpacked(x) for x in batch.column("asks").to_pylist()]
            of_row = np.cumsum([0, *[len(unpacked(x)[0]) for x in batch.column("word").to_pylist()]])
            block = np.concatenate([np.repeat(a[0], a[1].astype(np.int64)) for a in asks]).astype(np.int64)
            of = np.concatenate([np.cumsum(a[2], dtype=np.uint32).astype(np.int64) + w for a, w in zip(asks, of_row, strict=False)])
            start = np.concatenate([part for a in asks for part in starts_of(a)])
            m, order, dish = (np.concatenate([a[i] for a in asks]).astype(np.int64) for i in (4, 5, 6))
            ask = np.repeat(np.arange(len(start)), m)
            known = np.flatnonzero(dish)
            at = d.cuts[of[ask[known]]] + dish[known] - 1
            n, tables = np.ones(len(ask), np.uint64), np.full(len(ask), len(shared), np.uint64)
            n[known], tables[known] = d.n[at], seated[at]
            by_block = np.argsort(block, kind="stable")
            ends = np.concatenate([[0], np.cumsum(m)])
            sorted_pairs = slices(ends, by_block)
            order, n, tables, ends = order[sorted_pairs].astype(np.uint32), n[sorted_pairs], tables[sorted_pairs], np.concatenate([[0], np.cumsum(m[by_block])])
            found, first = np.unique(block[by_block], return_index=True)
            data = []
            for a, b in zip(first, np.append(first[1:], len(block)), strict=True):
                mine, some = by_block[a:b], slice(ends[a], ends[b])
                data.append(packed([deltas(start[mine]), count[of[mine]], *root[:, of[mine]], m[mine].astype(np.uint32), order[some], n[some], tables[some]]))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.zeros(len(found), np.int32)), pa.array(data, pa.binary())], names=["block", "kind", "data"])

    return words.mapInArrow(run, ANSWERS)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def shares_of(t: Totals, customers: np.ndarray) -> np.ndarray:
    """By context, what a customer's share is a part of."""
    return (t.strength + customers).astype(np.float32)


def own_contexts(given: list[bytes], finals: list[Totals]) -> tuple[list[np.ndarray], np.ndarray]:
    """What score_blocks() needs of the contexts that a block brings, and these."""
    contexts, customers, *tables = (np.concatenate(x) for x in zip(*(unpacked(data) for data in given), strict=True))
    order = np.argsort(contexts)
    customers, *tables = (x[order].astype(float) for x in (customers, *tables))
    passed = [replace(t, customers=customers, tables=x).passed_on().astype(np.float32) for t, x in zip(finals, tables, strict=True)]
    return [shares_of(finals[0], customers), *passed], contexts[order]


def score_blocks(blocks: DataFrame, answered: DataFrame, finals: list[Totals], bits: int, tokens: float, brought: bool = False) -> DataFrame:
    """The mean over the samples of each token's probability, own share and root's together.

    tokens: of the training texts. brought: the finals don't have the contexts' customers and tables; rows of
    kind 1 bring those of the block's own: contexts, customers, tables by sample.
    """
    vectors = [] if brought else [shares_of(finals[0], finals[0].customers), *[t.passed_on().astype(np.float32) for t in finals]]
    bare = [replace(t, customers=np.zeros(0), tables=np.zeros(0), shared={}) for t in finals]
    given = blocks.sparkSession.sparkContext.broadcast((bare, vectors))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        finals, vectors = given.value
        out = []
        for data in left.column("data").to_pylist():
            ids, null, held, sizes, j, kinds, *of_many = unpacked(data)
            p = pairs_of(held, sizes, j, kinds, *of_many, bits)
            at = p.context
            if brought:
                vectors, contexts = own_contexts(of_kind(right, 1), finals)
                at = np.searchsorted(contexts, at)
            whole, *passed = vectors
            count, root = np.zeros(len(kinds)), np.zeros((2 * len(finals), len(kinds)))
            own = np.where(p.trained > 0, 1 - finals[0].discount, 0.0)
            for part in of_kind(right, 0):
                start, of_word, *at_root, m, order, n, tables = unpacked(part)
                start = np.cumsum(start, dtype=np.uint32)
                of = p.word[start]
                count[of] = of_word
                root[:, of] = at_root
                own[np.repeat(start, m) + order] = n - finals[0].discount * (tables / len(finals))
            own /= whole[at]
            chance = np.zeros(len(p.word))
            for s, t in enumerate(finals):
                chance += (own + passed[s][at] * t.at_root(root[2 * s], root[2 * s + 1])[p.word]) / len(finals)
            base = np.log10((count + 0.1) / (tokens + 0.1 * (finals[0].kinds + 1)))
            of = np.repeat(np.arange(len(sizes)), sizes)
            sums = [np.bincount(of, weights=x, minlength=len(sizes)) for x in ((count > 0)[j], base[j], np.log10(chance)[p.of])]
            out.append(
                pa.table(
                    [
                        pa.array(ids.view(np.int64), mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(sizes.astype(np.int64)), pa.array(sums[0].astype(np.int64)),
                        pa.array(np.full(len(sizes), int(tokens))), pa.array(sums[1]), pa.array(sums[2]),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            )
        return pa.concat_tables(out) if out else empty()

    def of_kind(right: pa.Table, kind: int) -> list[bytes]:
        return [data for k, data in zip(right.column("kind").to_pylist(), right.column("data").to_pylist(), strict=True) if k == kind]

    def empty() -> pa.Table:
        return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_())} | {k: pa.array([], pa.int64()) for k in ("n_tokens", "n_known", "train_tokens")} | {k: pa.array([], pa.float64()) for k in ("base_score", "score")})

    return blocks.drop("words").groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, SCORES)


def score(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each input row.

    held_out says which rows the model doesn't learn from (null: it does). Null and empty texts have the end
    token alone. Repeated rows count and are scored each for itself, so do rows with a null doc_id. Without
    training tokens every token has the probability of the one unknown word. Texts are read whole, a text
    of any length is in one block. Extra columns are ignored, an empty table gives no rows. The model's
    perplexity over some rows is 10 ** (-sum(score) / sum(n_tokens)).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    bits, shared = context_bits(docs), shared_words(docs)
    if bits > BROADCAST_BITS:
        from .spread_model import scores

        return scores(read_blocks(docs, new_path(spark, "blocks"), bits, shared, salted_parts(spark)), bits)
    blocks = read_blocks(docs, new_path(spark, "blocks"), bits, shared)
    words = written(merged(word_rows(blocks, bits), bits), "words")
    totals, counts, single = begun(words, bits)
    chain = [totals]
    for sweep in range(BURN_IN):
        after, parties = swept(words, chain, single, bits)
        chain.append(fitted(after[0], parties, sweep))
    finals, _ = swept(words, chain, single, bits, SAMPLES)
    return score_blocks(blocks, answers(words, chain, finals, counts), finals, bits, float(totals.customers.sum()))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), remainder("doc_id", 10) == 0)
