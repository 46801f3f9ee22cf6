"""Connected components of a graph of links, by hash joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """node and component (its smallest node) of all nodes in links (a, b: long), written.

    Every round each node takes the smallest label among its neighbours, then the label of its label, until nothing
    changes. Rounds are written to the shared folder; a round's table goes when the next one is there. Smallest labels are
    pre-aggregated, so a node with many links is no heavy group; a link to a label that many share is an equi-join that
    Spark can split.

    A link of a node with itself, or with null, is none. Repeated links count once; without links there are no nodes. A component has one
    smallest node, so there are no ties. Columns of links besides a and b are ignored, whatever their names.
    """
    edges = links.select("a", "b").where("a <> b")
    edges = common.written(edges.union(edges.select("b", "a")).distinct(), f"{tag}-edges")
    labels = common.written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), tag)
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("at")).agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("at"), "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        jumped = lower.join(of, F.col("label") == F.col("to"), "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        found = common.written(jumped, tag)
        common.dropped(labels)
        labels = found
        if found.where("old <> label").isEmpty():
            common.dropped(edges)
            out = found.select("node", F.col("label").alias("component"))
            out._written_at = found._written_at
            return out
