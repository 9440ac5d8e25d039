"""The page tree, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import stored

INHERITED = ("resources", "media_box", "crop_box", "rotate")


def walk(nodes: DataFrame, inherited=INHERITED) -> DataFrame:
    """Pages of a table of nodes (doc_id, node, parent, kid_no, kind, and the inherited columns), in order.

    A page takes each inherited column from itself or the nearest node above that has it; a node that stands above
    itself is not followed again, so that the walk ends.  Roots have no parent.

    Each level is a join with the level above, which is stored, so that neither the number of nodes nor that of levels
    is limited and plans do not grow; pages are numbered within their document.
    """
    own = [F.col(f"n.{c}").alias(c) for c in inherited]
    handed = [F.coalesce(f"n.{c}", f"w.{c}").alias(c) for c in inherited]
    kids = nodes.where("parent IS NOT NULL").alias("n")
    roots = nodes.where("parent IS NULL").alias("n")
    level = stored(roots.select("n.doc_id", "n.node", "n.kind", F.array(F.coalesce("n.kid_no", F.lit(0))).alias("path"), F.array("n.node").alias("seen"), *own), "level")
    levels = []
    while level.head(1):
        levels.append(level.where("kind = 'Page'").select("doc_id", "node", "path", *inherited))
        above = level.alias("w")
        under = (F.col("n.doc_id") == F.col("w.doc_id")) & (F.col("n.parent") == F.col("w.node")) & ~F.expr("array_contains(w.seen, n.node)")
        level = stored(above.join(kids, under).select("n.doc_id", "n.node", "n.kind", F.concat("w.path", F.array("n.kid_no")).alias("path"), F.concat("w.seen", F.array("n.node")).alias("seen"), *handed), "level")
    pages = reduce(DataFrame.unionByName, levels) if levels else level.select("doc_id", "node", "path", *inherited)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1
    return pages.select("doc_id", "node", number.cast("int").alias("page_index"), *inherited)
