"""Quality rules whose cutoffs are risk-controlled on labelled documents.

Each rule rejects where a share of the text is at least a cutoff. For every stratum, rule and candidate
cutoff, the exact binomial probability of seeing so few rejected good documents, were the true rate of
false rejections above its limit, is a p-value. A rule's cutoffs are tested in a fixed sequence, from the
mildest on until one fails, which needs no correction within the sequence; Bonferroni's corrects for the
sequences of all strata and rules. Only cutoffs that pass may be used, so with probability 1 - delta no
stratum loses more than alpha of its good documents to the rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import halves, map_rows, map_same, table, texts, written

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
RULES = ("symbols", "repeats", "same_lines", "capitals", "marks", "short_words")
BINS = 64
#: What losing a share of the good documents costs against catching as large a share of the bad ones.
COST = 20
MOST_STRATA = 1000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(codes: np.ndarray, kinds: int, width: int = 3) -> int:
    """Words that lie in some window of width words that occurs twice or more."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    key, top = codes[:n].astype(np.int64), kinds
    for i in range(1, width):
        if top * kinds >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            top = int(key.max()) + 1
        key, top = key * kinds + codes[i : n + i], top * kinds
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(codes), bool)
    for i in range(width):
        covered[i : n + i] |= twice
    return int(covered.sum())


def measured(text: str) -> tuple[list[int], list[int]]:
    """The base counts, and the bin of each rule's share."""
    raw = text.encode()
    words = raw.split()  # at \x20 and \x09-\x0D, as for all bytes
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    n_words = len(words)
    word_chars = len(text) - sum(text.count(c) for c in BLANKS)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    seen, n_lines, n_dup = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
    n_repeat = repeated_words(codes, len(known))
    octets = np.frombuffer(raw, np.uint8)
    capitals = int(((octets >= 65) & (octets <= 90)).sum())
    marks = text.count("!") + text.count("?")
    chars, each = max(word_chars, 1), max(n_words, 1)
    mean = word_chars / each
    shares = (n_symbols / chars * 2, n_repeat / each, n_dup / max(n_lines, 1), capitals / chars, marks / chars * 2, max(0.0, 1 - mean / 8))
    return [n_words, word_chars, n_symbols, n_dup, n_repeat], [min(BINS - 1, int(s * BINS)) for s in shares]


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, the base counts, bins array<int>: a row for each input row, null texts as empty ones, a null stratum as ''."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            got = [measured(t) for t in texts(batch)]
            out = {name: [g[0][i] for g in got] for i, name in enumerate(BASE)}
            return out | {"doc_id": batch.column("doc_id"), "stratum": batch.column("stratum"), "bins": [g[1] for g in got]}

        return step

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "text")
    return map_rows(rows, make, "doc_id long, stratum string, " + ", ".join(f"{b} long" for b in BASE) + ", bins array<int>")


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) exactly; terms are summed from k downwards until they no longer matter."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    if k > p * n:
        return 1.0 - binomial_cdf(n - k - 1, n, 1 - p)
    total = 0.0
    while k >= 0 and term > total * 1e-17:
        total += term
        term *= k * (1 - p) / ((n - k + 1) * p)
        k -= 1
    return min(1.0, total)


@dataclass(frozen=True)
class Cutoffs:
    """by_stratum[stratum][rule]: the least bin that is rejected, BINS where the rule rejects nothing."""

    by_stratum: dict[str, list[int]]

    def rejects(self, stratum: str, bins: list[int]) -> bool:
        cut = self.by_stratum.get(stratum)
        return cut is not None and any(b >= c for b, c in zip(bins, cut, strict=True))


def learn(measured_docs: DataFrame, labels: DataFrame, alpha: float = 0.1, delta: float = 0.05) -> Cutoffs:
    """Cutoffs from all labelled documents; none from an empty table.

    Good and bad documents are counted by stratum, rule and bin on the executors; the counts (strata x rules
    x bins) come to the driver. Of the cutoffs that pass, a rule takes the one with the largest share of bad
    documents rejected less COST times that of good ones, the mildest of equal ones. Strata without enough
    labels get no cutoffs: they reject nothing. A document labelled twice counts as good only if all its
    labels are 1; null labels and labels of null ids count for nothing. More than MOST_STRATA strata with labels
    are an error, as their counts come to the driver and their cutoffs to every task.
    """
    good = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("good"))
    held = measured_docs.select("doc_id", "stratum", "bins").join(good, "doc_id")
    counted = held.select("stratum", "good", F.posexplode("bins").alias("rule", "bin")).groupBy("stratum", "good", "rule", "bin").agg(F.count("*").alias("n"))
    most = MOST_STRATA * 2 * len(RULES) * BINS
    counts = counted.limit(most + 1).collect()
    if len(counts) > most or len({r.stratum for r in counts}) > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} strata")
    hist: dict[str, np.ndarray] = {}
    for r in counts:
        hist.setdefault(r.stratum, np.zeros((2, len(RULES), BINS), np.int64))[int(r.good > 0), r.rule, r.bin] += r.n
    limit, level = alpha / len(RULES), delta / max(1, len(hist) * len(RULES))
    found = {s: [BINS] * len(RULES) for s in hist}
    for s in hist:
        above = hist[s][:, :, ::-1].cumsum(axis=2)[:, :, ::-1]  # rejected at each cutoff
        for rule in range(len(RULES)):
            n_bad, n_good, best = int(above[0, rule, 0]), int(above[1, rule, 0]), 0.0
            for cut in range(BINS - 1, 0, -1):
                bad, lost = int(above[0, rule, cut]), int(above[1, rule, cut])
                if binomial_cdf(lost, n_good, limit) > level:
                    break
                if (gain := bad / max(n_bad, 1) - COST * lost / n_good) > best:
                    best, found[s][rule] = gain, cut
    return Cutoffs({s: c for s, c in found.items() if min(c) < BINS})


def verdicts(measured_docs: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """The measures with base_failed and kept: a row for each, null ids and repeated rows too; no rows from none."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    hit = F.lit(False)
    if cutoffs.by_stratum:
        cuts = F.create_map(*[x for s, c in cutoffs.by_stratum.items() for x in (F.lit(s), F.array(*map(F.lit, c)))])
        at = F.coalesce(cuts[F.col("stratum")], F.array(*[F.lit(BINS)] * len(RULES)))
        hit = F.exists(F.arrays_zip(F.col("bins").alias("b"), at.alias("c")), lambda x: x["b"] >= x["c"])
    return measured_docs.withColumn("base_failed", failed).withColumn("kept", ~failed & ~hit)


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The documents that neither the base rules nor the learned ones reject, with all their columns as they were.

    Texts don't move: they are measured once for the cutoffs and again where they are kept or dropped. A
    null or empty text fails the base rules. Repeated rows are judged each for itself.
    """
    cutoffs = learn(measures(docs, stratum), labels)

    def run(batches):
        for whole in batches:
            for batch in halves(whole):
                keep = []
                for text, s in zip(texts(batch), batch.column(stratum).to_pylist(), strict=True):
                    base, bins = measured(text)
                    keep.append(not base_failed(base[0], base[4]) and not cutoffs.rejects("" if s is None else str(s), bins))
                yield batch.filter(pa.array(keep, pa.bool_()))

    return map_same(docs, run)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(measures(table(spark, sf_dir, "documents")), "measures")
    cutoffs = learn(stats, table(spark, sf_dir, "labels"))
    return verdicts(stats, cutoffs).select("doc_id", *BASE, "base_failed", "kept")
