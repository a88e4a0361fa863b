"""Connected components of undirected links, as DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpoint

#: Rows of links that make another task worth while: a round over fewer is put together in fewer tasks than the session's shuffles
#: have, as each task of each exchange leaves files.
ROUND_ROWS = 100_000


def connected(links: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Components of ``links`` (columns u and v, and those in ``by``, which keep links apart): ``by``, id, label.

    There is a row for every id in a link to another one; its label is the least id of its component. The published large-star
    and small-star steps take turns: each joins ids with their least neighbour, so an id's neighbours need never meet in one
    task, and long chains shrink by a constant factor in a round. Lineage is cut after each round; rounds end when the links,
    by then stars, stay as they are.
    """
    keep = list(by)
    edges = checkpoint(links.select(*keep, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    before, n = None, edges.count()
    while True:
        few = lambda df, n=n: df.coalesce(max(1, math.ceil(2 * n / ROUND_ROWS)))
        both = few(edges.union(edges.select(*keep, "v", "u")))
        least = both.groupBy(*keep, "u").agg(F.min("v").alias("m")).select(*keep, "u", F.least("u", "m").alias("m"))
        met = both.join(least, [*keep, "u"]).filter("v > u").select(*keep, F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        large = few(few(met).distinct())
        least = large.groupBy(*keep, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*keep, "u"])
        pairs = small.select(*keep, "u", F.col("m").alias("v")).union(small.select(*keep, F.col("v").alias("u"), F.col("m").alias("v")))
        edges = checkpoint(few(few(pairs.filter("u != v")).distinct()))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keep, "u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    members = edges.select(*keep, F.col("u").alias("id"), F.col("v").alias("label"))
    return members.union(edges.select(*keep, F.col("v").alias("id"), F.col("v").alias("label")).distinct())
