"""The language model where contexts are too many for one vector.

What the restaurants have together is a table with a row for each range of contexts, packed. Before a sweep each
group of words asks each range for its contexts' tables, once each, in a packed row; after it the group sends
its sums in rows of the same kind, which are added up by range. Blocks get their own contexts' totals for the
scores likewise. So rows grow with groups and ranges, not with dishes. Seating and scores are those of
language_model.py, with the same random numbers, so results are the same.

Words, the tables that they are told before each sweep, and blocks are written in buckets of their groups and
blocks, so that sweeps, answers and scores find them where they are: only sums, requests and answers move.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_model as model
from .base import drop_path, salted_parts, written, written_by


def settled(spark: SparkSession, *done: DataFrame) -> None:
    """Removes tables that nothing reads any more, and lets Spark remove the files of exchanges that are through."""
    for path in {f.rsplit("/", 1)[0] for df in done for f in df.inputFiles()}:
        drop_path(spark, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def range_shift(blocks: DataFrame, bits: int) -> int:
    """The bits of a context within its range: a range for two to four groups of words."""
    return max(0, bits - max(1, model.groups_of(blocks).bit_length() - 2))


def by_range(contexts: np.ndarray, shift: int) -> Iterator[tuple[int, slice]]:
    """The ranges that ascending contexts have, and where."""
    found, first = np.unique(contexts >> np.uint64(shift), return_index=True)
    for k, a, b in zip(found.tolist(), first, [*first[1:], len(contexts)], strict=False):
        yield k, slice(a, b)


def added(given: list[list[np.ndarray]], number: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts, ascending, and the sums of each of the arrays that stand behind them."""
    contexts, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *[g[0] for g in given]]), return_inverse=True)
    arrays = [np.concatenate([np.zeros(0), *[g[1 + i].astype(float) for g in given]]) for i in range(number)]
    return contexts, np.array([np.bincount(place, weights=a, minlength=len(contexts)) for a in arrays])


def row_of(k: int, contexts: np.ndarray, arrays: np.ndarray) -> pa.Table:
    return pa.table({"k": pa.array([k], pa.int64()), "data": pa.array([model.packed([contexts, *np.asarray(arrays).astype(np.uint64)])], pa.binary())})


def nothing() -> pa.Table:
    return pa.table({"k": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})


def sums(words: DataFrame, number: int, shift: int, start: Callable[[], tuple[Callable, Callable]]) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """Written rows (k, data) of sums by context, not added up over the batches yet, and what end gives, added up over the tasks as reduced() does.

    start gives a task's step (contexts and number arrays of whole numbers for a batch) and end (the rest, and values of words in several parts).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, end = start()
        for batch in model.together(batches):
            contexts, arrays = step(batch)
            contexts, sums = added([[contexts.astype(np.uint64), *arrays]], number)
            for k, some in by_range(contexts, shift):
                yield from row_of(k, contexts[some], sums[:, some]).to_batches()
        yield model.sums_rows([np.zeros(0)], *end())

    rows = written(words.mapInArrow(run, model.SUMS), "sums")
    return rows, model.reduced(rows.where("k < 0"))


def begun(words: DataFrame, bits: int, shift: int) -> tuple[model.Totals, dict[int, int], DataFrame]:
    """As there, with a table (k, data) of contexts, customers, dishes of one customer, and tables, by range."""

    def start() -> tuple[Callable, Callable]:
        rest, shared = np.zeros(6), {}

        def step(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
            d = model.Dishes.of_batch(batch)
            rest[:] += model.first_counts(d, shared)
            own, none = d.word >> np.uint64(64 - bits), np.zeros(len(d.ctx))
            arrays = [(d.count, none), (np.zeros(len(own)), d.n), (np.zeros(len(own)), none + 1)]
            return np.concatenate([own, d.ctx.astype(np.uint64)]), [np.concatenate(a) for a in arrays]

        return step, lambda: (rest, shared)

    def total(group: pa.Table) -> pa.Table:
        contexts, (customers, large, dishes) = added([model.unpacked(x) for x in group.column("data").to_pylist()], 3)
        return row_of(group.column("k")[0].as_py(), contexts, np.array([customers, customers - large, customers - large + dishes]))

    rows, got = sums(words.select(*model.DISHES), 3, shift, start)
    table = written(rows.where("k >= 0").groupBy("k").applyInArrow(total, model.SUMS), "contexts")
    settled(words.sparkSession, rows)
    return *model.first_totals(got, np.zeros(0), np.zeros(0)), table


def asked(requests: DataFrame, table: DataFrame, columns: list[int]) -> DataFrame:
    """id, data: the contexts that an id asks a range for, and those columns of the table.

    requests: k (the range), id, data (differences of contexts). Contexts that no training text has get zeros.
    """

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        known = [model.unpacked(x) for x in right.column("data").to_pylist()]
        contexts, totals = added(known, len(known[0]) - 1 if known else max(columns) + 1)
        contexts, totals = np.append(contexts, np.uint64(2**64 - 1)), np.hstack([totals, np.zeros((len(totals), 1))])[columns].astype(np.uint64)
        out = []
        for data in left.column("data").to_pylist():
            some = np.cumsum(model.unpacked(data)[0], dtype=np.uint32).astype(np.uint64)
            at = np.searchsorted(contexts, some)
            at = np.where(contexts[at] == some, at, len(contexts) - 1)
            out.append(model.packed([some, *totals[:, at]]))
        return pa.table({"id": left.column("id"), "data": pa.array(out, pa.binary())})

    return requests.groupBy("k").cogroup(table.groupBy("k")).applyInArrow(answer, "id long, data binary")


def request(asker: int, contexts: np.ndarray, shift: int) -> pa.RecordBatch:
    rows = [(k, asker, model.packed([model.deltas(contexts[some])])) for k, some in by_range(contexts, shift)]
    k, ids, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["k", "id", "data"])


REQUESTS = "k long, id long, data binary"


def before_sweep(words: DataFrame, table: DataFrame, name: str, shift: int, buckets: int = 1) -> DataFrame:
    """row, name: the contexts of the dishes of each row of words, and their tables; in buckets by row."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data in zip(batch.column("row").to_pylist(), batch.column("ctx").to_pylist(), strict=True):
                yield request(row, np.unique(model.unpacked(data)[1]).astype(np.uint64), shift)

    def one(group: pa.Table) -> pa.Table:
        contexts, tables = added([model.unpacked(x) for x in group.column("data").to_pylist()], 1)
        return pa.table({"row": pa.array([group.column("id")[0].as_py()], pa.int64()), name: pa.array([model.packed([contexts, *tables.astype(np.uint64)])], pa.binary())})

    got = asked(words.select("row", "ctx").mapInArrow(ask, REQUESTS), table, [2])
    return written_by(got.groupBy("id").applyInArrow(one, f"row long, {name} binary"), name, "row", buckets)


def swept(words: DataFrame, chain: list[model.Totals], table: DataFrame, alone: float, shift: int, samples: int = 1) -> tuple[list[model.Totals], list[np.ndarray], DataFrame]:
    """As there, with a table of contexts, customers, dishes of one customer (alone: of all contexts), and tables by sample."""
    given = words.sparkSession.sparkContext.broadcast(chain)

    def start() -> tuple[Callable, Callable]:
        rest, shared = np.zeros(2 * samples + 2 * model.PARTY), {}
        stirling = model.stirlings(given.value)

        def step(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
            d = model.Dishes.of_batch(batch)
            got = model.sweeps(d, given.value, samples, stirling)
            rest[:] += model.sweep_counts(d, got, shared)
            return d.ctx, [t for t, _, _ in got]

        return step, lambda: (rest, shared)

    def seated(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return nothing()
        contexts, customers, single, *_ = model.unpacked(left.column("data")[0].as_py())
        found, tables = added([model.unpacked(x) for x in right.column("data").to_pylist()], samples)
        now = np.tile(single.astype(float), (samples, 1))
        now[:, np.searchsorted(contexts, found)] += tables
        return row_of(left.column("k")[0].as_py(), contexts, np.vstack([customers, single, now]))

    rows, got = sums(words.drop("asks"), samples, shift, start)
    after, parties = model.swept_totals(got, chain, samples)
    now = written(table.groupBy("k").cogroup(rows.where("k >= 0").groupBy("k")).applyInArrow(seated, model.SUMS), "contexts")
    settled(words.sparkSession, rows, table)
    parties[0][model.EXACT + 2] += alone
    return after, parties, now


def restaurants(table: DataFrame) -> tuple[np.ndarray, float, float]:
    """model.restaurants() of all contexts, their customers and their dishes of one customer; tasks send their sums."""
    shape = len(model.DISCOUNTS), len(model.STRENGTHS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape[0] * shape[1] + 2)
        for batch in batches:
            for data in batch.column("data").to_pylist():
                _, customers, single, tables, *_ = model.unpacked(data)
                total += np.append(model.restaurants(customers.astype(float), tables.astype(np.float32).astype(float)).ravel(), [customers.sum(), single.sum()])
        yield model.sums_rows([np.zeros(0)], total, {})

    got = model.reduced(table.select("data").mapInArrow(run, model.SUMS))
    _, total = model.listed(got, -1)
    total = total[0] if len(total) else np.zeros(shape[0] * shape[1] + 2)
    return total[:-2].reshape(shape), float(total[-2]), float(total[-1])


def of_blocks(blocks: DataFrame, table: DataFrame, bits: int, shift: int) -> DataFrame:
    """Rows of kind 1 for score_blocks(): the contexts that a block has, and those contexts' customers and tables."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(*(batch.column(c).to_pylist() for c in ("block", "words")), strict=True):
                yield request(block, np.unique(np.frombuffer(words, np.uint64) >> np.uint64(64 - bits)), shift)

    got = asked(blocks.select("block", "words").mapInArrow(ask, REQUESTS), table, [0, *range(2, 2 + model.SAMPLES)])
    return got.select(F.col("id").alias("block"), F.lit(1).alias("kind"), "data")


def scores(blocks: DataFrame, bits: int) -> DataFrame:
    """What language_model.score() gives, from its blocks."""
    shift, buckets = range_shift(blocks, bits), salted_parts(blocks.sparkSession)
    words = written_by(model.merged(model.word_rows(blocks, bits), bits), "words", "row", buckets)
    settled(blocks.sparkSession)
    first, counts, table = begun(words, bits, shift)
    _, tokens, alone = restaurants(table)
    chain, seen = [first], words
    for sweep in range(model.BURN_IN):
        seen = seen.join(before_sweep(words, table, f"tables_{sweep}", shift, buckets), "row", "left")
        after, parties, table = swept(seen, chain, table, alone, shift)
        chain.append(model.fitted(after[0], parties, sweep, restaurants(table)[0]))
    seen = seen.join(before_sweep(words, table, f"tables_{model.BURN_IN}", shift, buckets), "row", "left")
    finals, _, table = swept(seen, chain, table, alone, shift, model.SAMPLES)
    told = model.answers(seen, chain, finals, counts).unionByName(of_blocks(blocks, table, bits, shift))
    return model.score_blocks(blocks, told, finals, bits, tokens, brought=True)
