"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structmine.llm.shared import kept


def components(links: DataFrame) -> DataFrame:
    """``doc, component`` of every linked document; a component is named by its smallest document.

    Alternating contraction (large star, small star): every round is two aggregates with map-side
    combine and two joins, so a document with any number of links is combined before it moves.  Each
    round is written to the shared folder; the rounds end when the links no longer change.
    """
    one, two = links.columns
    links = links.where(F.col(one) != F.col(two)).select(F.greatest(one, two).alias("a"), F.least(one, two).alias("b"))
    links, state = kept(links.distinct(), "stars"), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        ends = F.explode(F.array("a", "b")).alias("a")
        small = large.join(lowest, "a").select(ends, F.col("low").alias("b"))
        links = kept(small.where("a <> b").distinct(), "stars")
        digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        found = tuple(links.agg(F.count(F.lit(1)), digest).first())
        if found == state:
            break
        state = found
    stars = links.select(F.col("a").alias("doc"), F.col("b").alias("component"))
    return stars.unionByName(links.select(F.col("b").alias("doc"), F.col("b").alias("component")).distinct())
