"""Connected components over link tables, without a link leaving the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Written (node, component): the smallest node reachable from each linked node, itself included.

    Alternates large-star and small-star steps; each step is two shuffles over the
    links, written to the shared folder, and the number of rounds grows with the
    logarithm of the longest path.  Self links and repeated links do no harm.
    """
    edges = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = written(small.select("e.u", "e.v").where("u <> v").distinct(), "small")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(edges, large)
        edges = small
        if now == state or now[0] == 0:
            break
        state = now
    # at the end every edge leads to its component's smallest node
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"), F.col("v").alias("component")).distinct()
    out = written(ends, "components")
    drop(edges)
    return out
