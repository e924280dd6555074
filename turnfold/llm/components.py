"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(links: DataFrame) -> tuple[DataFrame, int]:
    """node, root (least node reachable) for every node in `links` (x, y: long, not null), a written table, and its rows.

    A round: each node takes the least root among its own and its neighbours' (combined before the
    shuffle, so that hubs do no harm), then the root of its root. Rounds end when nothing changes,
    after about the logarithm of the longest path. Roots of few nodes are broadcast.
    """
    both = links.select("x", "y").union(links.select("y", "x")).filter("x != y")
    most = 2 * links.count()
    roots = C.written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("root")), "roots", most)
    n = roots.count()
    while True:
        seen = both.join(C.light(roots.withColumnRenamed("node", "y"), n), "y").groupBy("x").agg(F.min("root").alias("least"))
        step = seen.join(C.light(roots, n), roots["node"] == seen["x"]).select("node", F.least("root", "least").alias("new"), (F.col("least") < F.col("root")).alias("moved"))
        step = C.written(step, "roots", n)
        if not step.filter("moved").limit(1).count():
            return step.select("node", F.col("new").alias("root")), n
        jump = C.light(step.select(F.col("node").alias("new"), F.col("new").alias("far")), n)
        roots = step.join(jump, "new", "left").select("node", F.coalesce(F.least("far", "new"), F.col("new")).alias("root"))
        if n > C.LIGHT_ROWS:
            roots = C.written(roots, "roots", n)


def merged(roots: DataFrame | None, n: int, links: DataFrame) -> tuple[DataFrame, int]:
    """The components of `roots` (n rows; None: no link yet) with more links: the new ones meet between roots only."""
    if roots is None:
        return components(links)
    of = C.light(roots, n)
    ends = links
    for end in ("x", "y"):
        ends = ends.join(of.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}", end))
    ends = C.written(ends.select(F.col("rx").alias("x"), F.col("ry").alias("y")), "root-links", links.count())
    over, m = components(ends)
    top = C.light(over.select(F.col("node").alias("root"), F.col("root").alias("top")), m)
    old = roots.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # roots of one node were in no link before
    new = over.join(C.light(roots.select("node"), n), "node", "left_anti")
    out = C.written(old.unionByName(new), "roots", n + m)
    return out, out.count()
