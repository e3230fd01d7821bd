"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a folder under the temporary one; a cluster without the
    setting is an error, since a machine's own folder would lose rows there.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    return f"{tempfile.gettempdir()}/cellsift-scratch"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the scratch folder, removed when the application ends."""
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop, fs = place(spark, path)
    fs.deleteOnExit(hadoop)
    return path


def place(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop, fs = place(spark, path)
    fs.delete(hadoop, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df, computed once and kept as Parquet in the scratch folder: it survives lost executors and ends its lineage."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, label: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """As written(), in buckets by key: joins and groups by key move none of its rows, other tables go to its buckets.

    The catalog has the table only until it is read; the folder holds it.
    """
    spark = df.sparkSession
    path = path or new_path(spark, label)
    name = f"{label}_{uuid.uuid4().hex}"
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    df.write.format("parquet").bucketBy(min(buckets, most), key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of an external table, so the files stay
    return out


def file_bytes(df: DataFrame) -> int:
    """Of the files that df is read from, by their folders."""
    found = [place(df.sparkSession, path) for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}]
    return sum(fs.getContentSummary(hadoop).getLength() for hadoop, fs in found)
