"""Connected components by label propagation with pointer jumping, each round a table in shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop_scratch, scratch_table

FOLD = 8


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) -> doc_id, component: the smallest number reachable, for every node that has a link. Every node is a
    neighbour of itself, so a round hears its own number, too."""
    ends = [links.select(F.col(a).alias("doc_id"), F.col(b).alias("near")) for a, b in (("a", "b"), ("b", "a"), ("a", "a"), ("b", "b"))]
    edges = scratch_table(ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3]).distinct(), "edges", FOLD)
    labels = edges.groupBy("doc_id").agg(F.min("near").alias("component"))
    last = None
    while True:
        heard = edges.join(labels.select(F.col("doc_id").alias("near"), "component"), "near")
        jump = heard.groupBy("doc_id").agg(F.min("component").alias("component"), F.min(F.when(F.col("near") == F.col("doc_id"), F.col("component"))).alias("old"))
        up = jump.select(F.col("doc_id").alias("component"), F.col("component").alias("top"))
        after = jump.join(up, "component", "left").select("doc_id", F.least("component", F.coalesce("top", "component")).alias("component"), "old")
        table = scratch_table(after, "labels", FOLD)
        if last is not None:
            drop_scratch(last)
        last = table
        labels = table.select("doc_id", "component")
        if not table.where("component <> old").limit(1).count():
            drop_scratch(edges)
            return labels
