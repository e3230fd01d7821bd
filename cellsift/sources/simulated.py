"""Count experiments drawn from known cell types, for tests and for trying things out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def draw(spark: SparkSession, types: list[tuple[str, int, float, np.ndarray]], seed: int = 1, first: int = 0) -> DataFrame:
    """droplet_idx, truth, gene_idx, count: droplets drawn from multinomials on the executors.

    types: name, number of droplets, mean size and gene weights of each. Each droplet's own generator follows
    from seed and index, so the draw is the same whatever the partitions.
    """
    parts, start = [], first
    for name, n, size, weights in types:
        share = np.asarray(weights, float) / np.sum(weights)

        def counts(batches, share=share, size=size, name=name):
            for pdf in batches:
                rows = []
                for i in pdf["id"]:
                    rng = np.random.default_rng([seed, int(i)])
                    x = rng.multinomial(max(1, rng.poisson(size)), share)
                    rows += [(int(i), name, int(g), float(x[g])) for g in np.flatnonzero(x)]
                yield pd.DataFrame(rows, columns=["droplet_idx", "truth", "gene_idx", "count"])

        parts.append(spark.range(start, start + n).mapInPandas(counts, "droplet_idx long, truth string, gene_idx int, count double"))
        start += n
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def sample(spark: SparkSession, genes: int = 1001, droplets: int = 2451, types: int = 5, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """counts, genes, droplets shaped like a small nuclei experiment.

    13 mitochondrial genes (mt-) and Malat1 among them, two thirds of the droplets a long tail of debris rich in
    mitochondrial counts, the rest nuclei of some types with markers of their own.
    """
    rng = np.random.default_rng(seed)
    base = rng.gamma(0.4, 1.0, genes)
    names = [f"mt-G{i}" for i in range(13)] + ["Malat1"] + [f"Gene{i}" for i in range(14, genes)]
    ambient = base.copy()
    ambient[:13] *= 12
    tail = droplets * 2 // 3
    kinds = [("debris", tail, 40.0, ambient)]
    left = droplets - tail
    for t in range(types):
        own = base.copy()
        own[13] *= 40
        own[14 + t * 40 : 14 + (t + 1) * 40] *= 15
        kinds.append((f"type{t + 1}", left // types + (t < left % types), 900.0, own))
    made = draw(spark, kinds, seed)
    dimension = spark.createDataFrame(list(enumerate(names)), "gene_idx int, gene string")
    return made.select("gene_idx", "droplet_idx", "count"), dimension, spark.range(droplets).select(F.col("id").alias("droplet_idx"), F.concat(F.lit("N"), "id").alias("droplet"))
