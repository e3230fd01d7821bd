"""Best-fit decreasing packing of tokenised documents into sequences of bounded length.

Token counts are small integers, so bins with the same room are alike: the whole corpus' packing
follows from how many pieces each length has. Executors count lengths, the driver packs the counts
(at most 2,048 numbers, whatever the corpus), and executors look their pieces' places up.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import map_rows, texts, written


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable bytes stand for themselves, others for code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """Text -> ids of the tokenizer in the JSON file, as the tokenizers library gives them without adding special tokens.

    The file's added tokens are found in a text wherever their strings stand, and part it. The JSON's own
    vocabulary is run by tiktoken, whose ids for it are the same and come 4 to 5 times as fast: its ids are in
    merge order, so the id is the rank. A file whose added tokens take blanks, words' ends or normalised
    text into account, which tiktoken can't, is run by tokenizers itself.
    """
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        added = model.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word")) or model.get("normalizer"):
            whole = Tokenizer.from_file(path)
            _ENCODERS[path] = lambda text: whole.encode(text, add_special_tokens=False).ids
            return _ENCODERS[path]
        special = {t["content"]: t["id"] for t in added}
        letters = byte_alphabet()
        ranks = {bytes(letters[c] for c in w): i for w, i in model["model"]["vocab"].items() if w not in special}
        found = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        names = set(special)
        _ENCODERS[path] = lambda text: found.encode(text, allowed_special=names)
    return _ENCODERS[path]


class RoomTree:
    """Segment tree over the rooms 0..most: which rooms have open bins, least room of a given size or more."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, room: int, on: bool) -> None:
        i = room + self.size
        self.any[i] = on
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """Up from the leaf until a right neighbour has bins, then down to its first leaf."""
        i = need + self.size
        if self.any[i]:
            return need
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


@dataclass
class Plan:
    """Runs of pieces of one length: piece `rank` of `length` goes to sequence first + (rank - rank0) // each."""

    length: np.ndarray
    rank0: np.ndarray
    first: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.length.astype(np.int64) << 44 | self.rank0
        i = np.searchsorted(key, length.astype(np.int64) << 44 | rank, side="right") - 1
        n = rank - self.rank0[i]
        return self.first[i] + n // self.each[i], self.offset[i] + n % self.each[i] * length


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """Packs counts[length] pieces of each length, longest first, each into the open bin with least sufficient room.

    Bins with equal room are kept as runs of consecutive numbers. The next piece of the same length fits
    best where the last one went, as long as it fits there, so a run of bins takes its pieces in one step.
    Runs grow by three at most for each length, so the plan stays small for any number of pieces.
    """
    tree, open_bins = RoomTree(capacity), {}
    rows: list[tuple[int, int, int, int, int]] = []
    used = 0

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            open_bins.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            room = tree.tightest(length)
            if room is None:
                room, first, bins = capacity, used, -(-(n - rank) // (capacity // length))
                used += bins
            else:
                first, bins = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            each = room // length
            full = min(bins, (n - rank) // each)
            left = n - rank - full * each if full < bins else 0
            rows.append((length, rank, first, each, capacity - room))
            rank += full * each + left
            add(room - each * length, first, full)
            if left:
                add(room - left * length, first + full, 1)
            add(room, first + full + bool(left), bins - full - bool(left))
    rows.sort()
    return Plan(*(np.array([r[i] for r in rows], np.int64) for i in range(5)), used)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, dealt int, local long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece; local: its rank among the pieces of its length in its task."""

    def make():
        encode, seen, task = encoder(tokenizer), {}, TaskContext.get()
        dealt = task.partitionId() if task else 0

        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "local")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                ids = np.array([*encode(text), end_id], "<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    seen[b - a] = (local := seen.get(b - a, -1) + 1)
                    for name, x in zip(out, (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), local), strict=True):
                        out[name].append(x)
            return out | {"dealt": [dealt] * len(out["piece"])}

        return step

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece's place.

    A null or empty text is one piece with the end id alone. Repeated rows are packed each for itself;
    a null doc_id stays null. Extra columns are ignored. An empty table gives no rows. Documents longer
    than capacity are cut into pieces of capacity, the first of which may be shorter.
    """
    import public_tokenizers

    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), capacity, end_id), "pieces")
    dealt = cut.groupBy("dealt", "length").agg(F.count("*").alias("n"))
    # A length has one row for each task at most here.
    before = dealt.select("dealt", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("dealt")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(best_fit_decreasing(counts, capacity))

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            sequence, offset = plan.value.place(length, rank)
            return {x: batch.column(x) for x in names} | {"sequence_id": sequence, "offset": offset}

        return step

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = cut.join(before, ["dealt", "length"]).select(*names, (F.col("before") + F.col("local")).alias("rank"))
    return map_rows(ranked, make, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .base import table

    return pack(table(spark, sf_dir, "documents"))
