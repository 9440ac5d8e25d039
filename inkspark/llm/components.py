"""Connected components by rounds of smallest-label exchange and pointer jumping, all as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: parts in which rows that share a hot vertex look its label up
SALT = 16
#: vertices with more links than this are hubs; the ``HUBS`` with the most are salted, so that no other has over 1 in ``HUBS`` of all
HOT, HUBS = 1000, 500


def hubs(both: DataFrame) -> DataFrame | None:
    """(hub) of at most ``HUBS`` vertices that many links of ``both`` (a, b) lead to; None if there are none."""
    most = both.groupBy("b").count().where(F.col("count") > HOT).orderBy(F.desc("count"), "b").limit(HUBS)
    found = [r["b"] for r in most.collect()]
    return both.sparkSession.createDataFrame([(v,) for v in found], f"hub {both.schema['b'].dataType.simpleString()}") if found else None


def of_neighbours(both: DataFrame, labels: DataFrame, hub: DataFrame | None) -> DataFrame:
    """(a, component): the label of b for each link; a hub's label goes to ``SALT`` parts and each of its links to one of them."""
    if hub is None:
        return both.join(labels, both.b == labels.v).select("a", "component")
    hub = F.broadcast(hub)
    part = F.when(F.col("hub").isNull(), 0).otherwise(F.pmod(F.xxhash64("a"), F.lit(SALT)).cast("int"))
    parted = both.join(hub, F.col("b") == F.col("hub"), "left").select("a", "b", part.alias("p"))
    copies = F.when(F.col("hub").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALT - 1)))
    copied = labels.join(hub, F.col("v") == F.col("hub"), "left").select("v", "component", F.explode(copies).alias("q"))
    return parted.join(copied, (F.col("b") == F.col("v")) & (F.col("p") == F.col("q"))).select("a", "component")


def components(edges: DataFrame, rounds: int | None = None, start: DataFrame | None = None) -> DataFrame:
    """(v, component) of every vertex of ``edges`` (a, b): the smallest vertex that it reaches.

    Each round a vertex takes the smallest label among its own and its neighbours' and then that label's label, so a
    chain of n links needs about log n rounds.  Links are pre-aggregated before they are shuffled by vertex; those to a
    hub, and vertices that share a hot label, look it up in ``SALT`` parts.

    rounds: stop after so many, settled or not; vertices with the same label are connected even then.  start: labels
    (v, component) to begin with, vertices that each reaches; they may have vertices without links, which keep theirs.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(both, "links")
    hub = hubs(both)
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    if start is not None:
        labels = labels.withColumnRenamed("component", "own").join(start, "v", "full").select("v", F.least("own", "component").alias("component"))
    labels = stored(labels, "labels")
    done = 0
    while rounds is None or done < rounds:
        done += 1
        near = of_neighbours(both, labels, hub).groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "v", "left").select("v", F.least("component", "near").alias("next"), F.col("component").alias("old"))
        jump = lower.select(F.col("v").alias("next"), F.col("next").alias("far")).join(lower.select("next").distinct(), "next")
        jump = jump.select("next", "far", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
        parted = lower.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int"))
        new = stored(parted.join(jump, ["next", "part"], "left").select("v", F.least("next", F.coalesce("far", "next")).alias("component"), "old"), "labels")
        labels = new.select("v", "component")
        if rounds is None and not new.where("component <> old").head(1):
            break
    return labels
