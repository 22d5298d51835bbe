"""Advisory tables from a dump of OSV-format JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.functions.versions import version_key

_RECORD = """
    id string, summary string, withdrawn string,
    severity array<struct<type string, score string>>,
    database_specific struct<severity string>,
    affected array<struct<
        package struct<ecosystem string, name string>,
        versions array<string>,
        ranges array<struct<type string, events array<struct<introduced string, fixed string, last_affected string>>>>
    >>
"""


def _by_version(a: Column, b: Column) -> Column:
    """Order of two events: null keys first, then by key and turn."""
    first = F.struct(a["key"].isNotNull(), a["key"], a["turn"])
    second = F.struct(b["key"].isNotNull(), b["key"], b["turn"])
    return F.when(first < second, -1).when(first > second, 1).otherwise(0)


def read_advisories(spark: SparkSession, source: str, multi_line: bool = True) -> DataFrame:
    """One row per advisory and affected package; withdrawn advisories are left out.

    A dump holds one document per file; pass ``multi_line=False`` for JSON lines. The events
    of a range are put in order of their versions ("0" is before all). Each ``introduced``
    event opens an interval up to the next ``fixed`` event, which is outside it, or the next
    ``last_affected`` event, which is inside.
    """
    records = spark.read.schema(_RECORD).option("multiLine", multi_line).json(source).filter("withdrawn IS NULL")
    package = records.select(
        "id",
        "summary",
        F.col("database_specific.severity").alias("db_severity"),
        "severity",
        F.explode("affected").alias("affected"),
    )

    def keyed(event: Column) -> Column:
        version = F.coalesce(event["introduced"], event["fixed"], event["last_affected"])
        # of one version: first what ends before it, then what begins with it, then what ends with it
        turn = F.when(event["fixed"].isNotNull(), 0).when(event["introduced"].isNotNull(), 1).otherwise(2)
        return F.struct(F.when(version != "0", version_key(version)).alias("key"), turn.alias("turn"), event.alias("event"))

    def intervals(events: Column) -> Column:
        ordered = F.transform(F.array_sort(F.transform(events, keyed), _by_version), lambda e: e["event"])

        def interval(event: Column, place: Column) -> Column:
            ends = F.filter(F.slice(ordered, place + 2, F.size(ordered)), lambda x: x["introduced"].isNull())
            end = F.get(ends, F.lit(0))
            return F.struct(
                event["introduced"].alias("introduced"),
                end["fixed"].alias("fixed"),
                F.when(end["fixed"].isNull(), end["last_affected"]).alias("last_affected"),
            )

        return F.transform(ordered, interval)

    ranged = F.filter("affected.ranges", lambda r: r["type"].isin("SEMVER", "ECOSYSTEM"))
    opened = F.filter(F.flatten(F.transform(ranged, lambda r: intervals(r["events"]))), lambda e: e["introduced"].isNotNull())
    lower = F.transform(
        opened,
        lambda e: F.struct(
            F.when(e["introduced"] != "0", e["introduced"]).alias("introduced"),
            e["fixed"].alias("fixed"),
            e["last_affected"].alias("last_affected"),
        ),
    )
    return package.select(
        "id",
        F.col("affected.package.ecosystem").alias("ecosystem"),
        F.col("affected.package.name").alias("name"),
        "summary",
        "db_severity",
        "severity",
        F.col("affected.versions").alias("versions"),
        lower.alias("ranges"),
    )
