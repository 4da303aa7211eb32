"""Exact percentiles of groups of any size, without the values of a group in one place.

Values are counted first, which combines before the shuffle. The counts are dealt out by ranges of (group, value), so even the values of a single group lie in many pieces; sums of the pieces, a
few rows for each group, tell which pieces hold the wanted ranks, and only those are ranked inside. A percentile between two ranks is interpolated.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.session import stored

c = F.col


def percentiles(rows: DataFrame, keys: list[str], wanted: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """The keys of every group that has a value, and a column for each wanted percentile ``name: (value, share)``; null where the group has no such value."""
    values = {str(value): value for value, _ in wanted.values()}
    names = list(values)
    pairs = F.array(*[F.struct(F.lit(i).alias("m"), value.cast("double").alias("x")) for i, value in enumerate(values.values())])
    counts = rows.select(*keys, F.inline(pairs)).where(c("x").isNotNull()).groupBy(*keys, "m", "x").agg(F.count(F.lit(1)).alias("n"))
    group = [*keys, "m"]
    # the range partitioning is drawn once: the table is stored with the number of each piece
    dealt = stored(counts.repartitionByRange(*group, "x").withColumn("piece", F.spark_partition_id()))
    sums = dealt.groupBy(*group, "piece").agg(F.sum("n").alias("size"))
    along = Window.partitionBy(*group).orderBy("piece")
    pieces = sums.withColumns({"start": F.sum("size").over(along) - c("size"), "total": F.sum("size").over(Window.partitionBy(*group))})
    shares = sorted({share for _, share in wanted.values()})
    place = lambda share: F.lit(share) * (c("total") - 1)
    ranks = [rank(place(share)) for share in shares for rank in (F.floor, F.ceil)]
    inside = lambda start, size: [(rank >= start) & (rank < start + size) for rank in ranks]
    held = F.lit(False)
    for found in inside(c("start"), c("size")):
        held = held | found
    chosen = pieces.where(held).select(*[c(key).alias(f"__{key}") for key in group], c("piece").alias("__piece"), "start", "total")
    same = c("piece") == c("__piece")
    for key in group:
        same = same & c(key).eqNullSafe(c(f"__{key}"))
    ranked = dealt.join(chosen, same).withColumn("before", c("start") + F.sum("n").over(Window.partitionBy(*group, "piece").orderBy("x")) - c("n"))
    picks = []
    for at, found in enumerate(inside(c("before"), c("n"))):
        picks.append(F.max(F.when(found, c("x"))).alias(f"r{at}"))
    ends = ranked.groupBy(*group).agg(F.first("total").alias("total"), *picks)
    between = []
    for at, share in enumerate(shares):
        low, high = c(f"r{2 * at}"), c(f"r{2 * at + 1}")
        between.append((low + (place(share) - F.floor(place(share))) * (high - low)).alias(f"p{at}"))
    lines = ends.select(*group, *between)
    return lines.groupBy(*keys).agg(*[F.max(F.when(c("m") == names.index(str(value)), c(f"p{shares.index(share)}"))).alias(name) for name, (value, share) in wanted.items()])
