"""Union-find over edge tables: connected components by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, written

#: Rounds after which something must be wrong: the count grows with the logarithm of the longest path.
MOST_ROUNDS = 60


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge; ids without edges aren't returned.

    Large-star and small-star rounds (Kiveris et al. 2014): every node points its larger neighbours, then its smaller
    ones, to the smallest one it knows. Each round is two group-bys on ids with map-side minima and two joins that
    adaptive execution may split; tables between rounds go to the shared folder. Stops when a round changes no edge.
    """
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours and the node itself point to the smallest neighbour
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down.hint("merge"), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e, last = written(small, "edges"), e
        discarded(last)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u"), F.count_if(F.col("u").isNull())).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components don't settle")
    found = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionAll(found.select("component", "component")).distinct()
