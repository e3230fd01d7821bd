"""What the operators share: tables, shared scratch space, shapes of Arrow functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop_path, file_bytes, new_path, scratch, written, written_by

__all__ = ["SALTS", "drop_path", "file_bytes", "halves", "map_rows", "map_same", "new_path", "part_of", "remainder", "salted_parts", "scratch", "spread_join", "table", "texts", "written", "written_by"]

#: Parts that the rows of one key are dealt to.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, most: int = 4 << 20) -> DataFrame:
    """mapInArrow with a function made once for each task; it gives columns by name for a batch of about `most` bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    shape = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in halves(batch, most):
                got = step(part)
                yield pa.RecordBatch.from_arrays(
                    [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in shape], schema=shape
                )
        trim()

    return df.mapInArrow(run, schema)


def map_same(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow that gives columns like those it gets; names of any kind, which mapInArrow itself doesn't take."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in run(b.rename_columns(names) for b in batches):
            yield got.rename_columns(plain_names)
        trim()

    plain_names = plain.columns
    return plain.mapInArrow(renamed, plain.schema).toDF(*names)


def trim() -> None:
    """Gives a task's freed memory back to the system; its worker waits for other tasks, and several may wait."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def halves(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Splits a batch until a part has about 4 MB or one row, so that long texts don't add up."""
    if batch.num_rows <= 1 or batch.nbytes <= most:
        if batch.num_rows:
            yield batch
        return
    mid = batch.num_rows // 2
    yield from halves(batch.slice(0, mid), most)
    yield from halves(batch.slice(mid), most)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Null texts as empty ones."""
    return [x or "" for x in batch.column(name).to_pylist()]


def remainder(column: str, modulus: int):
    """crc32 of an id written as text, modulo."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def salted_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def part_of(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def spread_join(big: DataFrame, small: DataFrame, key: str, part: Column) -> DataFrame:
    """big joined with the one row that small has for each key, or none; a key's rows in big go to SALTS tasks.

    Only keys and parts that occur meet small, so it isn't multiplied by SALTS.
    """
    dealt = big.withColumn("_part", part)
    return dealt.join(dealt.select(key, "_part").distinct().join(small, key), [key, "_part"]).drop("_part")
