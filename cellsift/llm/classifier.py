"""A quality classifier learned from trusted positives and unlabelled text (non-negative PU risk)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import map_rows, remainder, table, texts
from .quality import measured

#: Trusted positives and unlabelled documents that the model is fitted on, about, at most. Everything is scored.
SAMPLE = 20_000
HIDDEN = 16
#: Standard errors that are taken off the estimated prior; learn() chooses one on a part of its own rows.
SHIFTS = (0.0, 2.0, 4.0, 8.0)
#: Share of the learning rows that the choice is made on.
CHOICE = 5


def classes() -> np.ndarray:
    """A column for each kind of byte: ASCII punctuation by itself; lower, upper, digits, blanks, the rest together."""
    kind = np.full(256, 4)
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[[32, *range(9, 14)]] = 3
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    kind[marks] = 5 + np.arange(len(marks))
    return np.eye(5 + len(marks))[kind]


_CLASSES = classes()


def features(text: str) -> np.ndarray:
    """Shares of the kinds of bytes, the quality rules' shares, and the length; zeros but for the last of an empty text."""
    octets = np.frombuffer(text.encode(), np.uint8)
    shares = np.bincount(octets, minlength=256) @ _CLASSES / max(1, len(octets))
    base, bins = measured(text)
    return np.concatenate([np.sqrt(shares), np.array(bins) / 64, [np.log1p(base[0]) / 10, 1.0]])


@dataclass
class Model:
    """A network with one hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    w2: np.ndarray
    prior: float

    def hidden(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.w1)
        return np.column_stack([h, np.ones(len(h))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.w2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def risk(model: Model, positive: np.ndarray, unlabelled: np.ndarray) -> tuple[float, float, list[np.ndarray]]:
    """prior * R+(P), then R-(U) - prior * R-(P), with logistic loss; and the gradients by w1 and w2 of what is to be stepped down.

    That is the sum of both; where the second part is below zero, the step goes up its gradient instead, as
    in non-negative PU learning, so that the model doesn't fit the noise of the difference.
    """
    n, m = len(positive), len(unlabelled)
    x = np.concatenate([positive, unlabelled])
    h = model.hidden(x)
    z = np.clip(h @ model.w2, -40, 40)
    s = 1 / (1 + np.exp(-z))  # slope of the negative loss; s - 1 that of the positive one
    loss = np.logaddexp(0, z)
    first, second = model.prior * np.logaddexp(0, -z[:n]).mean(), loss[n:].mean() - model.prior * loss[:n].mean()
    slope = np.concatenate([-model.prior * s[:n] / n, s[n:] / m])
    if second < 0:
        slope = -slope
    else:
        slope[:n] += model.prior * (s[:n] - 1) / n
    back = slope[:, None] * model.w2[:-1] * (1 - h[:, :-1] ** 2)
    return float(first), float(second), [((x - model.mean) / model.scale).T @ back, h.T @ slope]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 20, seed: int = 3) -> Model:
    """Minimises prior * R+(P) + max(0, R-(U) - prior * R-(P)) in minibatches, by risk()'s gradients and falling steps."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    model = Model(both.mean(0), both.std(0) + 1e-2, rng.normal(0, 0.3, (both.shape[1], HIDDEN)), rng.normal(0, 0.1, HIDDEN + 1), prior)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (model.w1, model.w2)]
    step, size = 0, 512
    rounds = max(1, max(len(positive), len(unlabelled)) // size)
    epochs = max(epochs, -(-600 // rounds))
    for _ in range(epochs):
        for _ in range(rounds):
            p, u = positive[rng.integers(0, len(positive), size)], unlabelled[rng.integers(0, len(unlabelled), size)]
            grads = risk(model, p, u)[2]
            step += 1
            for w, g, m in zip((model.w1, model.w2), grads, moments, strict=True):
                g = g + 1e-4 * w
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                w -= 5e-3 * (1 - step / (rounds * epochs + 1)) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return model


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[float, float]:
    """The share of positives in the unlabelled scores, by the best bin, and its standard error.

    Above a cutoff lie at least prior * (share of positives above it) of the unlabelled; the ratio of the two
    shares, where its upper confidence bound is least, is the estimate.
    """
    cuts = np.quantile(positive, np.linspace(0.005, 0.9, 180))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((u + slack) / p)
    return float(u[best] / p[best]), float(np.sqrt(u[best] * (1 - u[best]) / len(unlabelled)))


def clipped(prior: float) -> float:
    return float(np.clip(prior, 0.02, 0.98))


@dataclass
class Sample:
    """Features of learning rows: trusted positives, unlabelled ones, and rows labelled otherwise; choice marks CHOICE's part of each."""

    positive: np.ndarray
    unlabelled: np.ndarray
    negative: np.ndarray
    choice: dict[str, np.ndarray]


def sampled(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int) -> Sample:
    """About SAMPLE of each kind at most, by hash of the id, none of them held out. Null ids are no learning rows."""
    text_id = F.col("doc_id").cast("string")
    draw = F.pmod(F.xxhash64(text_id, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    known = labels.where(remainder("doc_id", modulus) != held_out).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q IS NOT NULL").withColumn("trusted", F.col("q") == 1)
    sizes = {r.trusted: r["count"] for r in known.groupBy("trusted").count().collect()}
    rate = lambda n: min(1.0, SAMPLE / max(1, n))
    marked = known.where(draw < F.when(F.col("trusted"), rate(sizes.get(True, 0))).otherwise(rate(sizes.get(False, 0)))).select("doc_id", "trusted")
    rest = docs.where(remainder("doc_id", modulus) != held_out)
    n = rest.count()
    # marked has about 2 SAMPLE ids at most
    rows = rest.select("doc_id", "text").join(F.broadcast(marked), "doc_id", "left").withColumn("drawn", draw < rate(n)).where("trusted IS NOT NULL OR drawn")
    rows = rows.withColumn("choice", F.pmod(F.xxhash64(text_id, F.lit("choice")), F.lit(CHOICE)) == 0)

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            return {c: batch.column(c) for c in ("trusted", "drawn", "choice")} | {"x": [features(t).astype(np.float32).tobytes() for t in texts(batch)]}

        return step

    got = map_rows(rows, make, "trusted boolean, drawn boolean, choice boolean, x binary").collect()
    got.sort(key=lambda r: bytes(r.x))  # the same model whatever the order
    kinds = {"positive": lambda r: r.trusted, "unlabelled": lambda r: r.drawn, "negative": lambda r: r.trusted is False}
    rows_of = {k: [r for r in got if f(r)] for k, f in kinds.items()}
    arrays = {k: np.array([np.frombuffer(r.x, np.float32).astype(float) for r in rows]) for k, rows in rows_of.items()}
    return Sample(**arrays, choice={k: np.array([r.choice for r in rows], bool) for k, rows in rows_of.items()})


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, threshold: float = 0.3) -> Model | None:
    """The model; None without positives or unlabelled documents, as from empty tables.

    The risk is that of positives and unlabelled rows. How many standard errors are taken off the estimated
    prior is chosen among SHIFTS by the mean of both kinds' shares that are told right at the threshold, on a
    fifth of the learning rows with labels, by models fitted without that fifth. Without labels of both kinds
    there it is the first of SHIFTS. Held-out rows take no part. Repeated rows count each; extra columns are
    ignored.
    """
    s = sampled(docs, labels, modulus, held_out)
    if not len(s.positive) or not len(s.unlabelled):
        return None
    half = np.arange(len(s.positive)) % 2 == 0
    first = fit(s.positive[half], s.unlabelled[::2], 0.5, epochs=10)
    spare = s.positive[~half] if (~half).any() else s.positive
    prior, error = estimated_prior(first.scores(spare), first.scores(s.unlabelled[1::2] if len(s.unlabelled) > 1 else s.unlabelled))
    good, bad = (getattr(s, k)[s.choice[k]] if len(getattr(s, k)) else [] for k in ("positive", "negative"))
    own, rest = s.positive[~s.choice["positive"]], s.unlabelled[~s.choice["unlabelled"]]
    shift = SHIFTS[0]
    if len(good) and len(bad) and len(own) and len(rest):
        def right(by: float) -> float:
            model = fit(own, rest, clipped(prior - by * error))
            return (model.scores(good) >= threshold).mean() + (model.scores(bad) < threshold).mean()

        shift = max(SHIFTS, key=right)
    return fit(s.positive, s.unlabelled, clipped(prior - shift * error))


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted: a row for each input row, repeated ones and null ids too.

    Null and empty texts are scored as empty ones; without a model all scores are 0.5. Texts are read whole.
    Extra columns are ignored, an empty table gives no rows.
    """

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            x = np.array([features(t) for t in texts(batch)])
            s = model.scores(x) if model else np.full(len(x), 0.5)
            return {"doc_id": batch.column("doc_id"), "score": s, "predicted": (s >= threshold).astype(np.int32)}

        return step

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, score double, predicted int")


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
