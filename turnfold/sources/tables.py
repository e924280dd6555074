"""Where requests come from: driver tables, capture folders, and a turn ledger made from events."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PATHS = ("/v1/chat/completions", "/v1/completions?stream=1", "/v1/responses/", "/v1/messages", "/v1/messages/count_tokens", "/v1/embeddings", "/v1/models", "/upload?part=2&name=x")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """seq, path, body of the .json files of a folder, in the order of their paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return files.select(F.row_number().over(Window.orderBy("path")).alias("seq"), "path", F.col("content").alias("body"))


def write_captures(requests: DataFrame, folder: str) -> None:
    """A capture sink: bodies as Parquet, in the order they came."""
    requests.write.mode("append").parquet(folder)


#: The ledger as SQL that Spark and DuckDB both read; DIV stands for integer division.
LEDGER = """
SELECT *, CASE WHEN split THEN CAST(60 + body DIV 10 + pushed * 300 AS BIGINT) ELSE CAST(body + 40 AS BIGINT) END AS wire,
  CASE WHEN NOT split THEN 'whole' WHEN seq % 211 = 0 THEN 'rebuild failed' ELSE 'rebuilt' END AS outcome FROM (
SELECT event_id AS seq, concat('p', CAST(user_id % 5 AS VARCHAR(9))) AS profile,
  CAST(event_id % 8 AS INT) AS path_no,
  200 + (event_id * 7919) % 20000 AS body, event_id % 7 AS refs, least(event_id % 7, (event_id * 3) % 8) AS refs_hit,
  event_id % 7 - least(event_id % 7, (event_id * 3) % 8) AS pushed,
  CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS repairs, 1000 + (event_id * 131) % 50000 AS link_us, 600 + (event_id * 101) % 40000 AS upstream_us, event_id % 307 = 0 AS upstream_failed, event_id % 401 = 0 AS link_failed,
  CASE WHEN event_id % 503 = 0 THEN 2 ELSE 0 END AS rejected, 100 + (event_id * 17) % 3000 AS response_bytes,
  200 + (event_id * 7919) % 20000 >= 4096 AND event_id % 8 < 6 AS split
FROM events) t
"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, profile, path, body, wire, refs, refs_hit, pushed, repairs, link_us, upstream_us, upstream_failed, link_failed,
    rejected, response_bytes, split, outcome: one row a turn."""
    e = table(spark, sf_dir, "events")
    n, body, refs = F.col("event_id"), 200 + (F.col("event_id") * 7919) % 20000, F.col("event_id") % 7
    path_no, hits = (n % 8).cast("int"), F.least(refs, (n * 3) % 8)
    out = e.select(
        n.alias("seq"), F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("profile"), F.get(F.array(*map(F.lit, PATHS)), path_no).alias("path"),
        body.alias("body"), refs.alias("refs"), hits.alias("refs_hit"), (refs - hits).alias("pushed"), F.when(n % 97 == 0, 1).otherwise(0).cast("long").alias("repairs"),
        (1000 + (n * 131) % 50000).alias("link_us"), (600 + (n * 101) % 40000).alias("upstream_us"), (n % 307 == 0).alias("upstream_failed"), (n % 401 == 0).alias("link_failed"),
        F.when(n % 503 == 0, 2).otherwise(0).cast("long").alias("rejected"), (100 + (n * 17) % 3000).alias("response_bytes"), ((body >= 4096) & (path_no < 6)).alias("split"),
    )
    out = out.withColumn("outcome", F.when(~F.col("split"), "whole").when(F.col("seq") % 211 == 0, "rebuild failed").otherwise("rebuilt"))
    return out.withColumn("wire", F.when(F.col("split"), 60 + F.floor(F.col("body") / 10) + F.col("pushed") * 300).otherwise(F.col("body") + 40).cast("long"))


@dataclass(frozen=True)
class Profile:
    name: str = "default"
    listen: str = "127.0.0.1:8787"
    peer: str = "127.0.0.1:8788"
    tls: bool = False
    tls_ca_file: str | None = None


@dataclass(frozen=True)
class Config:
    role: str = "local"
    enabled: bool = True
    min_body: int = 4096
    max_body: int = 512 << 20
    max_bytes: int = 200 << 20
    max_block: int = 200 << 20
    token: str = ""
    shadow: bool = False
    compress: bool = True
    tls: bool = False
    upstream: str = "http://127.0.0.1"
    profiles: tuple[Profile, ...] = (Profile(),)

    def problems(self) -> Iterator[str]:
        """What would silently do something else than was meant."""
        if self.role not in ("local", "remote"):
            yield "role must be local or remote"
        if self.role == "remote":
            if not self.upstream.startswith(("http://", "https://")):
                yield "upstream must be an http or https address"
            if self.tls and not self.token:
                yield "tls proves nothing without a token"
        if self.role == "local":
            if not self.enabled:
                yield "without splitting the local end only passes bodies on"
            for p in self.profiles:
                if p.listen == p.peer:
                    yield f"profile {p.name} listens on its own peer"
                if p.tls and not p.tls_ca_file:
                    yield f"profile {p.name} has tls without a certificate file"
            if len({p.listen for p in self.profiles}) < len(self.profiles):
                yield "two profiles listen on one address"
        if self.token and len(self.token) < 16:
            yield "a token has 16 characters at least"
        if self.max_block > self.max_bytes:
            yield "a block must fit into the store"

    def check(self) -> None:
        for problem in self.problems():
            raise ValueError(problem)


def load_config(path: str) -> Config:
    """JSON by its suffix, TOML otherwise; unknown names are ignored."""
    raw = Path(path).read_bytes()
    values = json.loads(raw) if path.endswith(".json") else tomllib.loads(raw.decode())
    own = lambda kind, given: {f.name: given[f.name] for f in fields(kind) if f.name in given}
    if "profiles" in values:
        values["profiles"] = tuple(Profile(**own(Profile, x)) for x in values["profiles"])
    out = Config(**own(Config, values))
    out.check()
    return out
