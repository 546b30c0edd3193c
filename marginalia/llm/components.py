"""Connected components of a graph given as edges, in DataFrame operations.

Min-label hooking with pointer jumping: every round sends the smallest label of a node's neighbours to the node and to
the node's present root, then halves the paths. Rounds grow with the logarithm of a component's diameter. Each round is
a table in the shared folder, so its lineage is cut and nothing is held by the driver but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import materialise, release


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b), any integer type, direction free, repeats and loops allowed -> (node, root): root is the smallest node reachable. Nodes without an edge aren't returned; null ends are no edge."""
    both = edges.where("a is not null and b is not null and a <> b")
    # both directions from one row, so that edges are computed once
    turned = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = materialise(both.select(turned).select("e.a", "e.b").distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "labels")
    before = labels
    while True:
        by_root = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        lifted = labels.join(by_root, "root").select("node", "root", "up")
        heard = both.join(lifted.select(F.col("node").alias("a"), F.col("up").alias("said")), "a").groupBy("b").agg(F.min("said").alias("said"))
        told = lifted.join(heard, F.col("node") == F.col("b"))
        news = told.select("node", "said").unionAll(told.select(F.col("root").alias("node"), "said")).unionAll(lifted.select("node", F.col("up").alias("said")))
        low = news.groupBy("node").agg(F.min("said").alias("said"))
        step = labels.join(low, "node").select("node", F.least("root", "said").alias("root"), (F.col("said") < F.col("root")).alias("moved"))
        step = materialise(step, "labels")
        release(before)
        before, labels = step, step.select("node", "root")
        if step.where("moved").isEmpty():
            release(both)
            return labels
