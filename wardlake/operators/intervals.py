"""Points in intervals of the same group, found by one sorted sweep over all groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.session import salted_join, written

#: Points of an interval that one row lists before they become rows of their own.
RUN = 1_024

# order of what stands at one place: bounds that leave it out, the point itself, bounds that take it in
_BEFORE, _POINT, _AFTER = 0, 1, 2


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, group: str, key: str, low: str, below: str, upto: str, salts: int = 16
) -> DataFrame:
    """Pairs of a point and an interval of its group with low <= key < below and key <= upto.

    Null bounds are open; ``key`` has no nulls and the type of the bounds; ``points`` is read
    twice. The result has the columns of ``points``, and
    ``interval`` with those of ``intervals`` but the group. The distinct points and bounds are
    sorted once, over all groups together, so that a group of any size lies on several tasks;
    each point gets its number, each bound the number of points before it, and an interval is
    then a range of numbers. The cost is that of the sort and of the pairs that come out.
    """
    interval = F.struct(*[c for c in intervals.columns if c != group])
    rows = written(intervals.select(group, interval.alias("interval")).distinct(), "intervals")

    def bound(column: str, side: int, kind: int) -> Column:
        value = F.col(f"interval.{column}")
        # open bounds stand before or after all points
        place = F.struct(F.when(value.isNull(), side).otherwise(0).alias("side"), value.alias("key"), F.lit(kind).alias("kind"))
        return F.struct(place.alias("at"), F.lit(side).alias("end"))

    bounds = F.array(bound(low, -1, _BEFORE), bound(below, 1, _BEFORE), bound(upto, 1, _AFTER))
    listed = rows.withColumn("bound", F.explode(bounds)).select(group, "interval", "bound.*")
    point = F.struct(F.lit(0).alias("side"), F.col(key).alias("key"), F.lit(_POINT).alias("kind"))
    events = listed.select(group, "at").unionByName(points.select(group, point.alias("at"))).distinct()
    # the table fixes which rows a part has, also when a task runs again
    dealt = written(events.repartitionByRange(group, "at").withColumn("part", F.spark_partition_id()), "interval-events")
    is_point = (F.col("at.kind") == _POINT).cast("long")
    seen = F.sum(is_point).over(Window.partitionBy("part").orderBy(group, "at").rowsBetween(Window.unboundedPreceding, 0))
    # one row per part
    parts = dealt.groupBy("part").agg(F.sum(is_point).alias("n"))
    earlier = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    numbered = dealt.withColumn("seen", seen).join(parts, "part").select(group, "at", (F.col("seen") + F.col("earlier")).alias("number"))
    numbered = written(numbered, "interval-numbers")

    spread = [F.col("interval")]
    placed = salted_join(listed, numbered.filter(F.col("at.kind") != _POINT), [group, "at"], "inner", spread, salts)
    ends = placed.groupBy(group, "interval").agg(
        F.max(F.when(F.col("end") < 0, F.col("number"))).alias("first"),
        F.min(F.when(F.col("end") > 0, F.col("number"))).alias("last"),
    )
    ranges = ends.filter("first < last")
    runs = ranges.withColumn("from", F.explode(F.sequence(F.col("first") + 1, F.col("last"), F.lit(RUN).cast("long"))))
    to = F.least(F.col("last"), F.col("from") + (RUN - 1))
    hits = runs.select("interval", F.explode(F.sequence("from", to)).alias("number"))
    places = numbered.filter(F.col("at.kind") == _POINT).select(group, F.col("at.key").alias(key), "number")
    known = points.join(places, [group, key])
    return salted_join(hits, known, ["number"], "inner", spread, salts).select(*points.columns, "interval")
