"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Rows of a file of edges or labels; each written file costs a local file system two child processes, whatever it holds.
FILE_ROWS = 250_000


def few(rows: DataFrame, count: int) -> DataFrame:
    """The rows, about ``count`` at most, in as many parts as they need and one for each core at least."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // FILE_ROWS)))


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for each vertex of the edges (a, b): label is the least vertex of its component.

    Each round gives a vertex the least label of its neighbours and then that label's own label, so paths halve and
    stars are done in two rounds. Labels are written each round; only whether some changed reaches the driver.

    Edges with a null end join nothing and give no vertex of their own; repeated edges and loops count once; a loop alone is a
    component of one. No edges give no rows. Vertices are compared by their own order, so ties can't arise.

    Tables of a round are written in as many files as the edges need, one for each core at least.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    files = max(edges.sparkSession.sparkContext.defaultParallelism, -(-2 * edges.count() // FILE_ROWS))
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().coalesce(files), "edges")
    labels = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "v").coalesce(files), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("_near"))
        step = labels.join(near, labels["v"] == near["a"], "left").select("v", F.col("label").alias("_old"), F.least("label", F.coalesce("_near", "label")).alias("_mid"))
        jump = step.select(F.col("v").alias("_w"), F.col("_mid").alias("_far"))
        after = step.join(jump, step["_mid"] == jump["_w"], "left").select("v", "_old", F.least("_mid", F.coalesce("_far", "_mid")).alias("label"))
        after = cut(after.coalesce(files), "labels")
        changed = after.where("label <> _old").limit(1).count()
        labels = after.select("v", "label")
        if not changed:
            return labels
