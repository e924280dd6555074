"""Operator 10: mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Without weights of its own, a source's target is its size to this power.
POWER = 0.5
#: A rate is split into equal parts of at most so much, each with a draw of its own: Poisson counts
#: add up, and the inversion of a small mean is exact in doubles.
PART = 8
#: P(count > TAIL) for a mean of PART is under 2^-60, less than any draw can tell.
TAIL = 60
#: Up to so many sources are broadcast with their rates; more are joined on salted keys.
BROADCAST_ROWS, SALTS = 20_000, 64


def uniform(seed: int, *parts: Column) -> Column:
    """In [0, 1), 52 bits of md5 of the seed and the parts."""
    key = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def inverted(u: Column, mean: Column) -> Column:
    """The Poisson quantile of u for a mean of at most PART: how many sums of probabilities u reaches.

    u and the mean are carried along: an expression inside a step would be worked out again in each one.
    """
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("n"), u.alias("u"), mean.alias("mean"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * s["mean"] / k
        return F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"), (s["n"] + (s["u"] >= s["cdf"]).cast("int")).alias("n"), s["u"].alias("u"), s["mean"].alias("mean"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TAIL)), start, step, lambda s: s["n"])


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = POWER) -> DataFrame:
    """source, rate: how often each document of a source should come, so that characters follow the weights.

    The sum of expected characters is that of `docs`. A source without a weight gets 0 if weights are
    given. A source of no characters gets the rate 1. Sums are combined before the shuffle.
    """
    size = F.sum(F.length("text")).alias("size")
    own = docs.groupBy("source").agg(F.coalesce(size, F.lit(0)).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(power))
    else:
        weight = F.lit(0.0)
        for k, v in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(weight)
    own = own.withColumn("weight", weight)
    whole = own.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.coalesce(F.try_divide(F.col("weight") * F.col("all_size"), F.col("all_weight") * F.col("size")), F.lit(0.0)))
    return own.join(F.broadcast(whole)).select("source", rate.alias("rate"))


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = POWER, seed: int = 20, copy_col: str | None = None) -> DataFrame:
    """`docs`, every row as often as a Poisson draw says that its doc_id and text seed, in a random order.

    All columns stay; `copy_col` adds the number of the copy, from 0, and replaces a column of that name. Null sources are one source;
    null ids and texts draw like any other value. Equal rows draw alike. Empty tables stay empty.
    The order: rows are dealt to partitions and sorted in them by a hash of id, text and copy.
    """
    spark = docs.sparkSession
    if copy_col:
        docs = docs.drop(*[c for c in docs.columns if c.lower() == copy_col.lower()])
    names = {x: C.free_name(docs, x) for x in ("_rate", "_u_key", "_n", "_copy", "_mix_salt", "_mix_source", "_salt_of")}
    per = C.written(rates(docs, weights, power), "mixing-rates").withColumnsRenamed({"source": names["_mix_source"], "rate": names["_rate"]})
    cond = docs["source"].eqNullSafe(per[names["_mix_source"]])
    if per.count() <= BROADCAST_ROWS:
        out = docs.join(F.broadcast(per), cond, "left")
    else:
        salt = names["_mix_salt"]
        salted = docs.withColumn(salt, F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"))
        per = per.withColumn(names["_salt_of"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = salted.join(per, salted["source"].eqNullSafe(per[names["_mix_source"]]) & (salted[salt] == per[names["_salt_of"]]), "left").drop(salt, names["_salt_of"])
    key, rate, n, copy = names["_u_key"], F.col(names["_rate"]), names["_n"], names["_copy"]
    out = out.drop(names["_mix_source"]).withColumn(key, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    parts = F.greatest(F.lit(1), F.ceil(rate / PART).cast("int"))
    draws = lambda k: F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, j: acc + inverted(uniform(seed, k, j), rate / parts))
    # the key, which reads the whole text, is bound once a row, and the count is named once, so that neither is worked out again
    out = out.withColumn(n, F.get(F.transform(F.array(F.col(key)), draws), F.lit(0)))
    out = out.withColumn(copy, F.explode(F.slice(F.sequence(F.lit(-1), F.col(n) - 1), 2, 1 << 30)))
    where = F.xxhash64(F.lit(seed), F.col(key), F.col(copy))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = out.withColumn(key, where).repartition(spread, key).sortWithinPartitions(key, copy)
    out = out.drop(names["_rate"], key, n)
    return out.withColumnRenamed(copy, copy_col) if copy_col else out.drop(copy)
