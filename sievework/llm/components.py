"""Connected components of links between ids, by large-star and small-star rounds (Kiveris et al., 2014).

Each round is a few joins and aggregates whose rows are no more than the links; a written table cuts the lineage. An id
that many links share is aggregated on the map side and, where a join is skewed, split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WorkTable



def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of each id in links (a, b); ids without links aren't in it.

    The rounds end when a large star and a small star change nothing: then each id's only link goes to its smallest.
    Links from an id to itself, repeated ones and nulls are left out.
    """
    edges = WorkTable(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        e = edges.read()
        # large star: of each id, the larger neighbours are linked to the smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = WorkTable(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        # small star: of each id, the smaller neighbours and itself are linked to the smallest
        e = large.read()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        done = WorkTable(small, "small-star")
        state = done.read().agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges.drop()
        large.drop()
        edges = done
        if tuple(state) == before:
            return edges.read().select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.read().select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        before = tuple(state)
