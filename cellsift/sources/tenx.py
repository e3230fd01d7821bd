"""Reading and writing directories of MatrixMarket counts with gene and barcode lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Experiment
from ..operators.qc import create_experiment, raw_counts

#: File names of the two layouts.
V3 = ("matrix.mtx.gz", "features.tsv.gz", "barcodes.tsv.gz")
V2 = ("matrix.mtx", "genes.tsv", "barcodes.tsv")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def make_unique(df: DataFrame, name: str, idx: str, sep: str = ".") -> DataFrame:
    """df with unique names: the first one in the order of idx stays, later ones get sep and a number that makes a new name.

    Names are dealt by name, so each group of equal ones is numbered where it is. A number may give a name that
    is there already; only those few names are walked through on the driver.
    """
    rank = F.row_number().over(Window.partitionBy(name).orderBy(idx)) - 1
    numbered = df.withColumn("_n", rank).withColumn("_new", F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit(sep), F.col("_n").cast("string"))))
    present = df.select(F.col(name).alias("_new")).distinct()
    hit = numbered.where("_n > 0").join(present, "_new", "left_semi").select(name).distinct()
    clashing = [r[0] for r in hit.collect()]
    fixed: dict[tuple[str, int], str] = {}
    if clashing:
        rows = numbered.where(F.col(name).isin(clashing) & (F.col("_n") > 0)).orderBy(idx).select(name, "_n").collect()
        taken = {r[0] for r in df.where(F.regexp_replace(name, r"\Q" + sep + r"\E[0-9]+$", "").isin(clashing)).select(name).distinct().collect()} | set(clashing)
        counter = dict.fromkeys(clashing, 0)
        for old, n in rows:
            while True:
                counter[old] += 1
                new = f"{old}{sep}{counter[old]}"
                if new not in taken:
                    break
            taken.add(new)
            fixed[old, n] = new
        table = df.sparkSession.createDataFrame([(k[0], k[1], v) for k, v in fixed.items()], f"`{name}` string, _n int, _fixed string")
        numbered = numbered.join(table, [name, "_n"], "left").withColumn("_new", F.coalesce("_fixed", "_new"))
    return numbered.withColumn(name, F.col("_new")).select(df.columns)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """idx (from 0), line of a text file.

    Lines of a compressed file come from one task in order; of a plain one by the order of its splits, whose
    line counts are added up.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part"))
    counts = {r.part: r.n for r in lines.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(counts):
        before[part] = total
        total += counts[part]
    if not before:
        return lines.select(F.col("at").alias("idx"), "line")
    start = F.create_map(*[F.lit(v) for kv in before.items() for v in kv])[F.col("part")]
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return lines.select((start + inside).cast("long").alias("idx"), "line")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """gene_idx, droplet_idx (both from 0), count of a coordinate MatrixMarket file."""
    lines = spark.read.text(path).where("NOT startswith(value, '%') AND trim(value) <> ''")
    size = lines.first()["value"]  # the first line without a mark
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(parts.alias("p"), "value").where(F.col("value") != size).select((F.get("p", F.lit(0)).cast("int") - 1).alias("gene_idx"), (F.get("p", F.lit(1)).cast("long") - 1).alias("droplet_idx"), F.get("p", F.lit(2)).cast("double").alias("count"))
    n = int(size.split()[2])
    first = [int(float(v)) for v in size.split()]
    if rows.count() < n:  # an entry reads like the line with the sizes
        rows = rows.union(spark.createDataFrame([(first[0] - 1, first[1] - 1, float(first[2]))], rows.schema))
    return rows


def read_10x(spark: SparkSession, path: str, clip_end: bool = True, sep: str = ".") -> tuple[DataFrame, DataFrame, DataFrame]:
    """counts, genes, droplets of a directory in either layout; names are the genes' second column and the barcodes.

    clip_end cuts barcodes at their first dash. Both kinds of names are made unique with sep.
    """
    path = path.rstrip("/")
    names = V3 if exists(spark, f"{path}/{V3[0]}") else V2
    for n in names:
        if not exists(spark, f"{path}/{n}"):
            raise ValueError(f"{path}/{n} is missing")
    counts = read_matrix(spark, f"{path}/{names[0]}")
    genes = numbered_lines(spark, f"{path}/{names[1]}").select(F.col("idx").cast("int").alias("gene_idx"), F.get(F.split("line", "\t"), F.lit(1)).alias("gene"))
    droplets = numbered_lines(spark, f"{path}/{names[2]}").select(F.col("idx").alias("droplet_idx"), (F.regexp_replace("line", "-.*", "") if clip_end else F.col("line")).alias("droplet"))
    return counts, make_unique(genes, "gene", "gene_idx", sep), make_unique(droplets, "droplet", "droplet_idx", sep)


def experiment_from_10x(spark: SparkSession, path: str, clip_end: bool = True, sep: str = ".", name: str = "experiment") -> Experiment:
    return create_experiment(*read_10x(spark, path, clip_end, sep), name=name)


def write_10x(counts: DataFrame, genes: DataFrame, droplets: DataFrame, path: str) -> None:
    """Writes counts (gene_idx, droplet_idx, count), genes (gene_idx, gene) and droplets (droplet_idx, droplet) as a directory of the older layout.

    Numbers follow the order of gene_idx and droplet_idx. The layout asks for single files, so a task writes each.
    """
    spark = counts.sparkSession

    def place(df: DataFrame, idx: str) -> DataFrame:
        return df.select(idx, F.row_number().over(Window.orderBy(idx)).cast("long").alias(f"{idx}_line"))

    def file(lines: DataFrame, order: list[str], name: str) -> None:
        lines.repartition(1).sortWithinPartitions(*order).select("line").write.text(f"{path}/{name}.parts")
        jvm = spark.sparkContext._jvm
        parts = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.parts")
        fs = parts.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [f.getPath() for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.parts/part-*"))]
        if found:
            fs.rename(found[0], jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
        else:
            fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")).close()
        fs.delete(parts, True)

    entries = counts.join(place(genes, "gene_idx"), "gene_idx").join(place(droplets, "droplet_idx"), "droplet_idx")
    entries = entries.select(F.col("gene_idx_line").alias("g"), F.col("droplet_idx_line").alias("d"), F.col("count").cast("long").cast("string").alias("n"))
    size = f"{genes.count()} {droplets.count()} {counts.count()}"
    head = spark.createDataFrame([(0, 0, "%%MatrixMarket matrix coordinate integer general"), (0, 1, size)], "d long, g long, line string")
    file(head.union(entries.select("d", "g", F.concat_ws(" ", F.col("g").cast("string"), F.col("d").cast("string"), "n").alias("line"))), ["d", "g"], V2[0])
    file(genes.select("gene_idx", F.concat_ws("\t", F.concat(F.lit("ID"), F.col("gene_idx").cast("string")), "gene").alias("line")), ["gene_idx"], V2[1])
    file(droplets.select("droplet_idx", F.col("droplet").alias("line")), ["droplet_idx"], V2[2])


def write_bundle(x: Experiment, path: str, targets: bool = True, meta: bool = True) -> None:
    """Writes the clean (or all test) droplets for other tools: Parquet counts with names, genes, and droplets.

    meta adds what is known of the droplets to their names.
    """
    kind = "clean" if targets else "test"
    counts = raw_counts(x, kind).join(F.broadcast(x.genes.select("gene_idx", "gene")), "gene_idx").join(x.droplets.select("droplet_idx", "droplet"), "droplet_idx")
    counts.select("gene", "droplet", "count").write.parquet(f"{path}/counts")
    x.genes.write.parquet(f"{path}/genes")
    data = x.test_data().where("Call = 'Clean'") if targets else x.test_data()
    (data if meta else data.select("droplet_idx", "droplet")).write.parquet(f"{path}/droplets")
