"""Connected components of a table of links, by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetweave.llm.common import remove, written


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Joins to the least of a node and its neighbours the larger neighbours, or the smaller ones and the node."""
    up = links.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
    down = links.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
    if larger:
        least = up.union(down).groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
        made = up.join(least, "node").select(F.col("least").alias("lo"), F.col("other").alias("hi"))
    else:
        least = down.groupBy("node").agg(F.min("other").alias("least"))
        made = down.join(least, "node").select(F.col("least").alias("lo"), F.explode(F.array("node", "other")).alias("hi"))
    return made.where(F.col("lo") < F.col("hi")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component_id) for each node of links (a, b): the least node that it reaches.

    Nodes without links don't come out. Each round is written to the shared folder, so that lineage stays short;
    rounds go on until all links are stars, which takes about the logarithm of the longest path.
    """
    now = written(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links")
    while True:
        # stars already: every upper end has one link, and none is a lower end
        ends = now.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("lo", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty():
            break
        now, last = written(_stars(_stars(now, True), False), "links"), now
        remove(now.sparkSession, last)
    # every component is a star now
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component_id")).union(now.select(F.col("lo"), F.col("lo")).distinct())
