"""Points in intervals against all pairs."""

import random

from wardlake.operators.intervals import points_in_intervals

POINTS, INTERVALS = "g string, p string, k int", "g string, id int, lo int, hi int, last int"


def found(spark, points, intervals):
    p, i = spark.createDataFrame(points, POINTS), spark.createDataFrame(intervals, INTERVALS)
    rows = points_in_intervals(p, i, "g", "k", "lo", "hi", "last").select("g", "p", "k", "interval.id").collect()
    return sorted(tuple(r) for r in rows)


def all_pairs(points, intervals):
    def inside(k, lo, hi, last):
        return (lo is None or lo <= k) and (hi is None or k < hi) and (last is None or k <= last)

    return sorted({(g, p, k, i[1]) for g, p, k in points for i in intervals if i[0] == g and inside(k, *i[2:])})


def test_against_all_pairs(spark):
    """One group holds most points and intervals; keys repeat, bounds are open, closed, equal and reversed."""
    chance = random.Random(5)
    keys = {("hot" if n % 3 else chance.choice("abc"), f"p{n}"): chance.randrange(200) for n in range(2_500)}
    points = [(g, p, k) for (g, p), k in keys.items()]

    def bound(share):
        return chance.randrange(-5, 205) if chance.random() < share else None

    intervals = [(chance.choice(["hot", "hot", "a", "b", "z"]), n, bound(0.7), bound(0.5), bound(0.3)) for n in range(150)]
    intervals += [(g, 200, None, None, None) for g in ("hot", "c", "z")] + [("hot", 201, 50, 50, None), ("hot", 202, 50, None, 50), ("hot", 203, 60, 40, None)]
    expected = all_pairs(points, intervals)
    assert len(expected) > 40_000
    assert found(spark, points, [*intervals, *intervals[:20]]) == expected


def test_nothing_to_find(spark):
    assert found(spark, [], [("a", 1, None, None, None)]) == []
    assert found(spark, [("a", "p", 1)], []) == []
    assert found(spark, [(None, "p", 1)], [(None, 1, None, None, None)]) == []
