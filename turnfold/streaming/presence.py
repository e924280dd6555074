"""Live presence: which referred blocks a peer already has, as a stream whose state is a table for each batch.

A batch is worked out by aggregates that tasks combine before they meet, and by joins, so neither the number
of peers nor that of digests bounds the tasks. A folder holds all: `requests/batch=n`, `known/n` (the state
after batch n, which it replaces whole) and the log of the query. A batch that runs again writes the same again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

OUTPUT = "peer string, seq long, refs long, refs_hit long, push_blocks long, pushed_bytes long"
KNOWN = "peer string, epoch long, digest string, first long, len long, held boolean, stays boolean"
BLOCK = 1 << 16  # of seq, in which resets are looked for by one task


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def _epochs(rows: DataFrame) -> DataFrame:
    """epoch: the peer's last reset at or before each row, of this batch; null if there was none."""
    rows = rows.withColumn("block", F.floor(F.col("seq") / BLOCK))
    reset = F.when(F.col("reset"), F.col("seq"))
    blocks = rows.groupBy(F.col("peer").alias("of"), F.col("block").alias("at")).agg(F.max(reset).alias("m"))
    before = F.max("m").over(Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("of", "at", before.alias("before"))
    rows = rows.withColumn("inside", F.max(reset).over(Window.partitionBy("peer", "block").orderBy("seq")))
    rows = rows.join(blocks, F.col("peer").eqNullSafe(F.col("of")) & F.col("block").eqNullSafe(F.col("at")))
    return rows.withColumn("epoch", F.coalesce("inside", "before")).drop("block", "inside", "of", "at", "before")


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def step(rows: DataFrame, n: int, at: str) -> None:
    """Writes the requests of batch n and the state after it."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "true")  # streams turn it off for state of their own
    if "reset" in rows.columns:
        rows = _epochs(rows.withColumn("reset", F.coalesce("reset", F.lit(False))))
        ends = rows.filter("reset").groupBy(F.col("peer").alias("of")).agg(F.max("seq").alias("last"))
    else:
        rows = rows.withColumns({"reset": F.lit(False), "epoch": F.lit(None).cast("long")})
        ends = spark.createDataFrame([], "of string, last long")
    refs = rows.filter("not reset")
    first = refs.filter("digest is not null").groupBy("peer", "epoch", "digest").agg(F.min("seq").alias("first"), F.max("len").alias("len"), F.lit(False).alias("held"))
    old = spark.createDataFrame([], KNOWN) if not n else spark.read.schema(KNOWN).parquet(f"{at}/known/{n - 1}").filter("stays")
    old = old.select("peer", F.lit(None).cast("long").alias("epoch"), "digest", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("len"), F.lit(True).alias("held"))
    both = first.union(old).groupBy("peer", "epoch", "digest").agg(F.max("first").alias("first"), F.max("len").alias("len"), F.max("held").alias("held"))
    both = both.join(ends, F.col("peer").eqNullSafe(F.col("of")), "left")
    both.select("peer", "epoch", "digest", "first", "len", "held", F.col("epoch").eqNullSafe(F.col("last")).alias("stays")).write.mode("overwrite").parquet(f"{at}/known/{n}")
    first = spark.read.schema(KNOWN).parquet(f"{at}/known/{n}").filter("first is not null")
    met = refs.join(first.select("peer", "epoch", "digest", "first", "held"), _same(refs, first, "peer", "epoch", "digest"), "left")
    hit = refs["digest"].isNull() | F.col("held") | (F.col("first") < F.col("seq"))
    zero = F.lit(0).cast("long")
    parts = met.select(refs["peer"], "seq", F.lit(1).cast("long").alias("refs"), F.coalesce(hit, F.lit(False)).cast("long").alias("refs_hit"), zero.alias("push_blocks"), zero.alias("pushed_bytes"))
    parts = parts.union(first.filter("not held").select("peer", "first", zero, zero, F.lit(1).cast("long"), "len"))
    parts = parts.union(rows.filter("reset").select("peer", "seq", zero, zero, zero, zero))
    out = parts.groupBy("peer", "seq").agg(*[F.sum(c).alias(c) for c in ("refs", "refs_hit", "push_blocks", "pushed_bytes")])
    out.write.mode("overwrite").parquet(f"{at}/requests/batch={n}")
    if n > 1:
        _delete(spark, f"{at}/known/{n - 2}")


def presence(refs: DataFrame, at: str) -> DataStreamWriter:
    """A row of OUTPUT for each request of a stream of (peer, seq, digest, len), or with a boolean `reset` more,
    once it is started. Requests of a batch are taken in the order of seq. A row that is a reset is no reference:
    the peer has nothing when its request begins. A null digest needs no push."""
    return refs.writeStream.foreachBatch(lambda rows, n: step(rows, n, at)).option("checkpointLocation", f"{at}/log")


def requests(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema(OUTPUT).parquet(f"{at}/requests/*")
