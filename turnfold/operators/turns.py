"""Analytics over the turn ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import basis_points, human

#: Exported name and meaning of each counter.
EXPORTED = {
    "requests": ("requests_total", "Requests handled"), "split_requests": ("split_requests_total", "Requests that went as a program"), "passthrough": ("passthrough_requests_total", "Requests that went whole"),
    "body_bytes": ("body_bytes_total", "Bytes of request bodies"), "wire_bytes": ("wire_bytes_total", "Bytes sent over the link"), "refs": ("refs_total", "References made"), "refs_hit": ("refs_hit_total", "References that the peer knew"),
    "blocks_pushed": ("blocks_pushed_total", "Blocks sent to the peer"), "repairs": ("repairs_total", "Requests for which the peer asked again"), "rebuilds": ("rebuilds_total", "Bodies that the peer rebuilt"),
    "rebuild_failures": ("rebuild_failures_total", "Bodies sent whole after all"), "upstream_errors": ("upstream_errors_total", "Failures of the upstream"), "link_errors": ("link_errors_total", "Failures of the link"),
    "response_bytes": ("response_bytes_total", "Bytes that came back"), "link_us": ("link_microseconds_total", "Time on the link"), "upstream_us": ("upstream_microseconds_total", "Time at the upstream"), "store_rejected": ("store_rejected_total", "Blocks that the store refused"),
}

total = lambda c: F.sum(c).cast("long")
of_split = lambda c: F.sum(F.when(F.col("split"), F.col(c)).otherwise(0)).cast("long")


def counters(turns: DataFrame) -> DataFrame:
    """One row of lifetime sums."""
    flag = lambda c: F.sum(c.cast("long")).cast("long")
    return turns.agg(
        F.count("*").alias("requests"), flag(F.col("split")).alias("split_requests"), flag(~F.col("split")).alias("passthrough"), total("body").alias("body_bytes"), total("wire").alias("wire_bytes"),
        of_split("refs").alias("refs"), of_split("refs_hit").alias("refs_hit"), of_split("pushed").alias("blocks_pushed"), total("repairs").alias("repairs"),
        F.count_if(F.col("outcome") == "rebuilt").alias("rebuilds"), F.count_if(F.col("outcome") == "rebuild failed").alias("rebuild_failures"),
        F.count_if("upstream_failed").alias("upstream_errors"), F.count_if("link_failed").alias("link_errors"), total("response_bytes").alias("response_bytes"),
        total("link_us").alias("link_us"), total("upstream_us").alias("upstream_us"), total("rejected").alias("store_rejected"),
    )


def snapshot(turns: DataFrame) -> DataFrame:
    """The counters with times in whole milliseconds."""
    s = counters(turns)
    per = lambda c: F.floor(F.col(c) / 1000).cast("long")
    return s.withColumns({"link_ms": per("link_us"), "upstream_ms": per("upstream_us")}).drop("link_us", "upstream_us")


def buckets(turns: DataFrame, key: Column) -> DataFrame:
    """Sums by key, most saved first. Savings are of the sums, never under 0."""
    out = turns.groupBy(key.alias("key")).agg(F.count("*").alias("requests"), F.sum(F.col("split").cast("long")).alias("split_requests"), total("body").alias("body_bytes"), total("wire").alias("wire_bytes"), total("refs").alias("refs"), total("refs_hit").alias("refs_hit"), total("pushed").alias("pushed"), total("repairs").alias("repairs"))
    out = out.withColumn("saved_bytes", F.greatest(F.col("body_bytes") - F.col("wire_bytes"), F.lit(0)))
    out = out.withColumns({"saved_bp": basis_points(F.col("saved_bytes"), F.col("body_bytes")), "hit_bp": basis_points(F.col("refs_hit"), F.col("refs"))})
    return out.orderBy(F.desc("saved_bytes"), "key")


def recent(turns: DataFrame, n: int) -> DataFrame:
    """The newest n turns, oldest first."""
    return turns.orderBy(F.desc("seq")).limit(n).orderBy("seq")


def summary(turns: DataFrame) -> DataFrame:
    s = counters(turns)
    saved = F.format_string("%.1f", 100 - F.col("wire_bytes") * 100.0 / F.col("body_bytes"))
    return s.select(F.concat(human(F.col("body_bytes")), F.lit(" -> "), human(F.col("wire_bytes")), F.lit(", saved "), saved, F.lit("%, hits "), F.col("refs_hit"), F.lit("/"), F.col("refs"), F.lit(", repairs "), F.col("repairs"), F.lit(", requests "), F.col("requests")).alias("line"))


def prometheus(turns: DataFrame) -> DataFrame:
    """HELP, TYPE and value lines of each counter, numbered."""
    s = counters(turns)
    lines = [x for c, (name, said) in EXPORTED.items() for x in (F.lit(f"# HELP turnfold_{name} {said}"), F.lit(f"# TYPE turnfold_{name} counter"), F.concat(F.lit(f"turnfold_{name} "), F.col(c).cast("string")))]
    return s.select(F.posexplode(F.array(*lines)).alias("pos", "line"))


def sparkline(turns: DataFrame, n: int, width: int = 200, height: int = 40) -> DataFrame:
    """Points of a polyline over the newest n turns' saved bytes, as one text."""
    last = recent(turns, n).select("seq", F.greatest(F.col("body") - F.col("wire"), F.lit(0)).alias("v"))
    all_ = last.agg(F.array_sort(F.collect_list(F.struct("seq", "v"))).alias("p"), F.greatest(F.max("v"), F.lit(1)).alias("top"))
    count = F.size("p")
    x = lambda i: F.when(count == 1, F.lit(width // 2)).otherwise(F.floor(i * width / (count - 1)))
    points = F.transform("p", lambda s, i: F.concat(x(i).cast("string"), F.lit(","), (height - F.floor(s["v"] * height / F.col("top"))).cast("string")))
    return all_.select(F.array_join(points, " ").alias("points"))
