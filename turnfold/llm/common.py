"""What the operators share: tables, the shared folder, row keys and bounded id filters."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the id filter; its broadcast has at most FILTER_BITS / 64 rows of 16 bytes, whatever the input.
FILTER_BITS = 1 << 22


#: Up to so many rows of two or three numbers are broadcast.
LIGHT_ROWS = 50_000
#: Rows of a file of a table of a known number of narrow rows.
FILE_ROWS = 50_000
#: Rows of an Arrow batch, at most: texts are long, and a worker holds a batch or two.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to BATCH_ROWS, if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Gives back what a Python worker has freed: it lives on between tasks and stages, and allocators keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow that releases memory after each task."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(released, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only in local mode, where the session names none (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.gettempdir()}/turnfold-checkpoint"
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/turnfold"


#: Tables written by this process and not yet deleted.
_TABLES: list[str] = []


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cuts the lineage: `df` as a Parquet table in the shared folder, which survives lost executors.

    `rows`, where a bound is known, lets tables of few rows have few files and few last tasks. (On a
    local file system without Hadoop's native library, each file starts three processes of the JVM.)
    """
    spark = df.sparkSession
    small_batches(spark)
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(4, -(-rows // FILE_ROWS)))
    df.write.parquet(at)
    _TABLES.append(at)
    return spark.read.schema(df.schema).parquet(at)


def delete_tables(spark: SparkSession, keep: int = 0) -> None:
    """Deletes the tables written so far but the first `keep`: for callers that have consumed all that reads them."""
    for at in _TABLES[keep:]:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _TABLES[keep:]


def light(df: DataFrame, rows: int) -> DataFrame:
    """`df` to broadcast if its counted `rows` are at most LIGHT_ROWS; as it is, to shuffle, if more."""
    return F.broadcast(df) if rows <= LIGHT_ROWS else df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of `df` has, in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def row_key(df: DataFrame, *cols: str) -> Column:
    """64 bits that rows share only if all `cols` agree (or by a chance of 2^-64 a pair)."""
    return F.xxhash64(*[F.col(c) for c in cols])


def with_maybe(df: DataFrame, key: str, ids: DataFrame, id_col: str, flag: str) -> DataFrame:
    """`df` with boolean `flag`, false only if `key` is surely none of `ids`.

    A one-hash bit filter: `ids` of any number become at most FILTER_BITS / 64 rows, so what is
    broadcast has a proven bound. When it fills up it lets more rows through, never fewer.
    """
    word, bits = free_name(df, "_word"), free_name(df, "_bits")
    at = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(FILTER_BITS))
    one = lambda p: F.expr(f"shiftleft(1L, cast(({p}) % 64 as int))")
    table_ = (
        ids.select(at(id_col).alias("_p"))
        .select(F.expr("_p div 64").alias(word), one("_p").alias("_b"))
        .groupBy(word)
        .agg(F.bit_or("_b").alias(bits))
    )
    pos = free_name(df, "_pos")
    out = df.withColumn(pos, at(key)).withColumn(word, F.expr(f"{pos} div 64"))
    out = out.join(F.broadcast(table_), word, "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(one(pos)) != 0, F.lit(False))
    return out.withColumn(flag, hit).drop(pos, word, bits)
