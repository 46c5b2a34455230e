"""Connected components of an edge table, with labels that are the smallest member.

Each round every node takes the smallest label among its neighbours and itself, then the
label of its label (so chains shorten by half). Rounds are written to the shared folder, so
lineage stays short and lost executors cost one round. Neighbour minima are combined before
the shuffle: a node with a third of all edges costs one row per task. Where labels meet the edges of a hub, or the
nodes of a large component, they are broadcast, as there can only be few such hubs and components (``with_partners``); so no task
gets the rows of one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.llm.common import with_partners
from evisift.session import written


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)``; nodes without edges are not listed."""
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(),
        "edges",
    )
    edges_in_all = both.count()
    degrees = both.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("near"), F.count("*").alias("edges"))
    # each node with its label and its number of edges
    labels = written(degrees.select("b", F.least("near", "b").alias("label"), "edges"), "labels")
    while True:
        met = with_partners(both, labels, ["b"], "edges", total=edges_in_all)
        near = met.groupBy(F.col("a").alias("b")).agg(F.min("label").alias("near"))
        lower = written(labels.join(near, "b").select(
            "b", F.col("label").alias("old"), F.least("label", "near").alias("label"), "edges"
        ), "lower")
        sizes = lower.groupBy("label").agg(F.count("*").alias("nodes"))
        roots = lower.select(F.col("b").alias("root"), F.col("label").alias("up"))
        ups = written(sizes.join(roots, sizes["label"] == roots["root"]).select(sizes["label"], "up", "nodes"), "roots")
        jumped = written(
            with_partners(lower, ups, ["label"], "nodes").select("b", "old", F.least("label", F.coalesce("up", "label")).alias("label"), "edges"),
            "labels",
        )
        labels = jumped.select("b", "label", "edges")
        if jumped.filter("old <> label").isEmpty():
            return labels.select(F.col("b").alias("node"), "label")
