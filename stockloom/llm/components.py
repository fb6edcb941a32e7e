"""Connected components of a link table by alternating large and small stars."""

from pyspark.sql import functions as F

from stockloom.session import shared_folder


def _mark(edges):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def stars(links):
    """(u, v) for every node u that is linked to a smaller one: v is the smallest node that u can reach.

    links: two columns of longs. Each round keeps the components and moves links towards their smallest node; after about the
    logarithm of the longest path nothing moves. Rounds are written to the shared folder, so nothing is lost with an executor."""
    shared_folder(links.sparkSession)
    a, b = links.columns
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.when(F.col("v") == F.col("m"), F.struct(F.col("u"), F.col("m").alias("v"))).otherwise(F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = large.join(least, "u").select(F.explode(F.array_distinct(F.array(ends, F.struct(F.col("u"), F.col("m").alias("v"))))).alias("e")).select("e.*").distinct().checkpoint()
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    return edges
