"""Connected components of small edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonloom.functions.session import shared_folder


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): each node of the edges (u, v) with the least node that it is linked to; rounds halve the distances and end when no node moves."""
    shared_folder(edges.sparkSession)
    edges = edges.checkpoint()
    if not edges.limit(1).count():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    both = edges.where("u <> v").select("u", "v").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    now = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")).checkpoint()
    while True:
        near = both.join(now.select(F.col("node").alias("v"), F.col("component").alias("other")), "v").groupBy(F.col("u").alias("node")).agg(F.min("other").alias("other"))
        roots = now.select(F.col("node").alias("component"), F.col("component").alias("root"))
        least = now.join(near, "node", "left").join(roots, "component", "left").select("node", "component", F.least("component", F.coalesce("other", "component"), F.coalesce("root", "component")).alias("next"))
        moved = least.checkpoint()
        now = moved.select("node", F.col("next").alias("component"))
        if not moved.where("next <> component").limit(1).count():
            return now
