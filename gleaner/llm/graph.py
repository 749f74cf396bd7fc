"""Connected components of an edge table that may not fit anywhere but in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node of an edge; component is the smallest id reachable.

    Labels start as the node's own id. A round takes the smallest label among a node and its neighbours, then follows
    the labels one jump, so chains shrink by halves. Minima are partial aggregates: a node with very many neighbours is
    summed up in every task. Each round's labels are written to the shared folder. Self-loops and repeated edges do
    no harm; rows with a null end are left out.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b").distinct()
    both = written(e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near"))
        seen = written(labels.join(near, F.col("id") == F.col("a"), "left").select(
            "id", F.col("component").alias("old"), F.least("component", "near").alias("component")), "labels")
        roots = seen.select(F.col("component").alias("to")).distinct()
        jump = written(roots.join(seen, F.col("to") == F.col("id")).select("to", F.col("component").alias("further")), "roots")
        moved = written(seen.join(jump, F.col("component") == F.col("to"), "left").select(
            "id", "old", F.least("component", "further").alias("component")), "labels")
        labels = moved.select("id", "component")
        if moved.filter("component <> old").isEmpty():
            return labels
