"""Connected components of a graph given by its edges, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.session import scratch_dir


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Each round hooks every node to its smallest neighbour, follows these
    pointers to their ends by doubling, and contracts the trees; at most half
    of a component's nodes are ends, so the rounds grow with the logarithm of
    its size. Every step is a table in the shared folder: lineage stays short,
    a lost executor repeats one step, and both sides of each join are plain
    scans, so that a hub's rows can be split over tasks. Null ends and loops
    are left out; repeated edges do no harm. No edges give no rows.
    """
    spark = edges.sparkSession
    root = scratch_dir(spark, "components")
    count = 0

    def kept(df: DataFrame) -> DataFrame:
        nonlocal count
        count += 1
        df.write.parquet(f"{root}/{count}")
        return spark.read.parquet(f"{root}/{count}")

    u, v = F.col("u"), F.col("v")
    current = kept(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                   .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (u != v)).distinct())
    labels = None
    while not current.isEmpty():
        both = current.union(current.select(v.alias("u"), u.alias("v")))
        up = kept(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")))
        while True:  # follow the pointers
            over = up.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = kept(up.join(over, "p").select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            up = jumped.select("u", "p")
            if jumped.where("moved").isEmpty():
                break
        first = current.join(up, "u").select(F.col("p").alias("pu"), F.col("v").alias("u"))
        current = kept(first.join(up, "u").select(F.greatest("pu", "p").alias("u"), F.least("pu", "p").alias("v"))
                       .where(u != v).distinct())
        if labels is None:
            labels = up.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            over = up.select(F.col("u").alias("component"), F.col("p").alias("next"))
            labels = kept(labels.join(over, "component", "left")
                          .select("node", F.coalesce("next", "component").alias("component")))
    return _empty(spark, edges, a) if labels is None else labels


def _empty(spark: SparkSession, edges: DataFrame, a: str) -> DataFrame:
    kind = edges.schema[a].dataType.simpleString()
    return spark.createDataFrame([], f"node {kind}, component {kind}")
