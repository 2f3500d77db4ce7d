"""Connected components of a link table, by alternating large-star and small-star steps.

No component is ever gathered: each step is a partial aggregate for the smallest neighbour and a join back on
the node.  A step turns links into links to smaller nodes; the loop ends when a step changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def _toward_smallest(links: DataFrame, upward: bool) -> DataFrame:
    """One star step over links ``(hi, lo)``.

    ``upward`` (large star): every node's larger neighbours are linked to its smallest neighbour or itself.
    Otherwise (small star): every node and its smaller neighbours are linked to the smallest of them.
    """
    down = links.select(F.col("hi").alias("node"), F.col("lo").alias("near"))
    around = down.unionByName(links.select(F.col("lo").alias("node"), F.col("hi").alias("near"))) if upward else down
    least = around.groupBy("node").agg(F.min("near").alias("least"))
    least = least.select("node", F.least("node", "least").alias("least"))
    joined = around.join(least, "node")
    if upward:
        moved = joined.where(F.col("near") > F.col("node")).select(F.col("near").alias("hi"), F.col("least").alias("lo"))
    else:
        moved = joined.select(F.col("near").alias("hi"), F.col("least").alias("lo")).unionByName(
            least.select(F.col("node").alias("hi"), F.col("least").alias("lo")))
    return moved.where(F.col("hi") > F.col("lo")).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0))).first()
    return tuple(row)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node that has a link; ``root`` is the smallest node reachable from it.

    Links are undirected; self links and links with a null end are ignored; an empty table gives an empty one.
    """
    both = links.where(F.col(a) != F.col(b))
    now = stage(both.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        now = stage(_toward_smallest(_toward_smallest(now, True), False), "links")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    roots = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
