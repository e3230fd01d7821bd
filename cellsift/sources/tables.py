"""Count experiments from business and text tables: orders by brand, suppliers by part, documents by token."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Experiment
from ..operators.qc import create_experiment


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def indexed(names: DataFrame, name: str, out: str) -> DataFrame:
    """Distinct names numbered from 0 in their order; they are a dimension."""
    from pyspark.sql import Window

    return names.select(F.col(name).cast("string").alias(name)).distinct().select((F.row_number().over(Window.orderBy(name)) - 1).cast("int").alias(out), name)


def orders_by_brand(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Droplets are orders, genes brands, counts the quantities ordered."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("gene"))
    genes = indexed(part, "gene", "gene_idx")
    sold = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey"))
    counts = sold.groupBy(F.col("l_orderkey").alias("droplet_idx"), "gene").agg(F.sum("l_quantity").alias("count")).join(F.broadcast(genes), "gene").select("gene_idx", "droplet_idx", "count")
    droplets = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("droplet_idx")).distinct().withColumn("droplet", F.concat(F.lit("O"), "droplet_idx"))
    return counts, genes, droplets


def suppliers_by_part(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Droplets are suppliers, genes parts, counts the quantities sold."""
    sold = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("int").alias("gene_idx"), F.col("l_suppkey").alias("droplet_idx")).agg(F.sum("l_quantity").alias("count"))
    genes = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("gene_idx"), F.concat(F.lit("P"), "p_partkey").alias("gene"))
    droplets = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("droplet_idx"), F.concat(F.lit("S"), "s_suppkey").alias("droplet"))
    return sold, genes, droplets


def experiment(spark: SparkSession, sf_dir: str, which: str = "orders") -> Experiment:
    return create_experiment(*{"orders": orders_by_brand, "suppliers": suppliers_by_part}[which](spark, sf_dir), name=which)
