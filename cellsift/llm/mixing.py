"""Mixing sources to target weights by Poisson replication, in built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import salted_parts, table

#: A rate above this is drawn as a sum of several Poisson counts, so that exp(-rate) stays exact.
PART = 32.0
TERMS = 127
#: Up to so many sources their rates are broadcast (about 1 KB each); beyond, they are joined with salt.
BROADCAST_SOURCES = 10_000
SALTS = 64


def uniform(key: Column, salt: Column) -> Column:
    """In [0, 1): 52 bits of the MD5 of key and salt."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key, salt.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, volume: float) -> DataFrame:
    """source, rate: how often each document of the source shall occur on average, and the cumulated Poisson terms."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("size"))
    if weights:
        pairs = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        wanted = sizes.select("source", "size", F.coalesce(pairs[F.col("source")], F.lit(0.0)).cast("double").alias("weight"))
    else:
        wanted = sizes.select("source", "size", F.pow(F.col("size").cast("double"), F.lit(temperature)).alias("weight"))
    whole = wanted.agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size"))
    # whole has one row
    rate = F.coalesce(F.try_divide(F.lit(volume) * F.col("weight") * F.col("all_size"), F.col("all_weight") * F.col("size")), F.lit(0.0))
    with_rate = wanted.join(F.broadcast(whole)).select("source", rate.alias("rate")).withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    share = F.col("rate") / F.col("parts")
    start = F.struct(F.exp(-share).alias("p"), F.array(F.exp(-share)).alias("cdf"))

    def grow(s: Column, k: Column) -> Column:
        p = s["p"] * share / k
        return F.struct(p.alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + p)).alias("cdf"))

    terms = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, grow)["cdf"]
    return with_rate.select("source", "rate", "parts", terms.alias("cdf"))


def draws(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, volume: float = 1.0, seed: int = 17) -> DataFrame:
    """row (the document's columns), copy (from 0), rate and shuffle_key: each as often as its Poisson count says, in one global order.

    Weights are shares of the mixture by code points; without them a source weighs its size to the power
    of temperature. volume is the mixture's size against the input. A document's count depends on its id,
    its source's rate and the seed only. A null source is a source of its own. Sources of size 0 (only null
    or empty texts) have rate 0. Rows with equal ids have equal counts; a null id draws by its text. The
    order is that of shuffle_key, then of copy, text and source, so that equal ids have a defined one too.
    The documents may have columns of any names. An empty table gives no rows. Texts of any length move once.
    """
    spark = docs.sparkSession
    by_source = rates(docs, weights, temperature, volume)
    own = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).alias("key"), F.col("source").alias("of"))
    few = by_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    if few:
        dealt = own.join(F.broadcast(by_source), own["of"].eqNullSafe(by_source["source"]))
    else:
        salted = by_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        mine = own.withColumn("mine", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
        dealt = mine.join(salted, mine["of"].eqNullSafe(salted["source"]) & (mine["mine"] == salted["salt"]))

    def draw(acc: Column, part: Column) -> Column:
        u = uniform(F.col("key"), F.concat_ws("/", F.lit(str(seed)), part.cast("string")))
        # u as a variable of its own, so that it is hashed once and not for each term
        return acc + F.transform(F.array(u), lambda v: F.size(F.filter(F.col("cdf"), lambda c: c <= v)))[0]

    count = F.aggregate(F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0), draw)
    counted = dealt.where("rate > 0").select("row", "key", "rate", count.alias("n")).where("n > 0")
    copies = counted.select("row", "key", "rate", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    order = F.md5(F.concat_ws(":", "key", F.lit(f"order{seed}"), F.col("copy").cast("string")).cast("binary"))
    order = F.conv(F.substring(order, 1, 15), 16, 10).cast("long")
    # The 60-bit keys are even, so a key's range follows from the key; nothing has to be sampled.
    parts = salted_parts(spark)
    place = F.shiftright(F.shiftright("shuffle_key", 20) * F.lit(parts).cast("long"), 40).cast("int")
    return copies.select("row", "copy", "rate", order.alias("shuffle_key")).repartitionById(parts, place).sortWithinPartitions("shuffle_key", "copy", "row.text", "row.source")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, volume: float = 1.0, seed: int = 17) -> DataFrame:
    """The draws() with the documents' own columns, all of them as they were, whatever their names."""
    return draws(docs, weights, temperature, volume, seed).select("row.*")


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws(table(spark, sf_dir, "documents")).select("row.doc_id", "row.source", "row.lang", "row.text", "copy", "shuffle_key", F.round("rate", 9).alias("rate"))


ORACLE_OP4 = f"""
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size FROM documents GROUP BY source),
wanted AS (SELECT source, size, pow(CAST(size AS DOUBLE), 0.5) AS weight FROM sizes),
rates AS (
  SELECT source, CASE WHEN size > 0 THEN 1.0::DOUBLE * weight * (SELECT CAST(sum(size) AS BIGINT) FROM wanted)
                 / ((SELECT sum(weight) FROM wanted) * size) ELSE 0 END AS rate FROM wanted),
parts AS (SELECT source, rate, greatest(CAST(ceil(rate / {PART}) AS INT), 1) AS parts FROM rates),
cdf AS (
  SELECT source, 0 AS k, exp(-rate / parts) AS p, exp(-rate / parts) AS c FROM parts
  UNION ALL
  SELECT cdf.source, k + 1, p * (rate / parts) / (k + 1), c + p * (rate / parts) / (k + 1)
  FROM cdf JOIN parts ON cdf.source IS NOT DISTINCT FROM parts.source WHERE k < {TERMS}),
lists AS (SELECT source, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source),
counted AS (
  SELECT d.doc_id, d.source, d.lang, d.text, p.rate,
    CASE WHEN p.rate > 0 THEN list_sum(list_transform(range(0, p.parts), lambda i: len(list_filter(l.cdf, lambda c:
      c <= CAST(('0x' || substr(md5(CAST(d.doc_id AS VARCHAR) || ':17/' || i), 1, 13)) AS BIGINT) / 4503599627370496.0)))) ELSE 0 END AS n
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source JOIN lists l ON l.source IS NOT DISTINCT FROM p.source),
copies AS (SELECT *, unnest(range(0, CAST(n AS BIGINT))) AS copy FROM counted)
SELECT doc_id, source, lang, text, CAST(copy AS INT) AS copy,
  CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':order17:' || copy), 1, 15)) AS BIGINT) AS shuffle_key, round(rate, 9) AS rate
FROM copies
"""
