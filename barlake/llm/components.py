"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import drop, scratch


def components(nodes: DataFrame, edges: DataFrame, node: str = "node", rank: str = "rank") -> DataFrame:
    """(node, label): ``label`` is the smallest ``rank`` reachable from the node.

    ``edges`` has the columns a and b.  Each round every node takes the smallest
    label of its neighbours, and then the label of its label's owner (pointer
    jumping), until no label falls.  Labels are written to the shared folder each
    round; nothing but one count per round reaches the driver.  Ranks are unique
    per node and not null; nodes without an edge never enter the rounds."""
    spark = nodes.sparkSession
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))).filter("src <> dst").distinct()
    edge_path = scratch(spark, "edges")
    both.write.parquet(edge_path)
    both = spark.read.parquet(edge_path)
    touched = both.select(F.col("src").alias(node)).distinct()
    start = scratch(spark, "labels")
    nodes.select(node, F.col(rank).alias("own")).join(touched, node).withColumn("label", F.col("own")).write.parquet(start)
    at = start
    while True:
        labels = spark.read.parquet(at)
        seen = both.join(labels.select(F.col(node).alias("src"), "label"), "src").groupBy("dst").agg(
            F.min("label").alias("near"))
        lower = labels.join(seen.withColumnRenamed("dst", node), node, "left") \
            .withColumn("next", F.least("label", F.coalesce("near", "label")))
        path = scratch(spark, "labels")
        lower.select(node, "own", "label", "next").write.parquet(path)
        step = spark.read.parquet(path)
        jump = step.select(F.col("own").alias("next"), F.col("next").alias("far"))
        jumped = scratch(spark, "labels")
        step.join(jump, "next", "left").select(
            node, "own", F.least("next", F.coalesce("far", "next")).alias("label"),
            (F.least("next", F.coalesce("far", "next")) < F.col("label")).alias("fell")).write.parquet(jumped)
        fell = spark.read.parquet(jumped).filter("fell").limit(1).count()
        drop(spark, path)
        drop(spark, at)
        at = jumped
        if not fell:
            break
    drop(spark, edge_path)
    return spark.read.parquet(at).select(node, "label")
