"""Breadth-first discovery over a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import persisted


def discover(links: DataFrame, seeds: DataFrame, most_depth: int = 0, most_pages: int = 0) -> DataFrame:
    """url, depth of all pages that the seeds reach through ``links`` (source, target).

    One anti-join a level; 0 means no bound.  With a bound on pages, the level
    that exceeds it is cut in the order of the URL.
    """
    frontier = persisted(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "frontier")
    found = frontier
    depth = 0
    while not most_depth or depth < most_depth:
        depth += 1
        nxt = links.join(frontier.select(F.col("url").alias("source")), "source", "left_semi").select(F.col("target").alias("url")).distinct()
        nxt = persisted(nxt.join(found.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if nxt.head() is None:
            break
        if most_pages:
            room = most_pages - found.count()
            if room <= 0:
                break
            nxt = persisted(nxt.orderBy("url").limit(room), "frontier")
        found = persisted(found.unionByName(nxt), "found")
        frontier = nxt
    return found
