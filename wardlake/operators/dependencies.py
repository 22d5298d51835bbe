"""Dependencies of repositories, and their match against an advisory table."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.functions.cvss import advisory_severity
from wardlake.functions.versions import clean_version, is_concrete_version, version_key
from wardlake.operators.intervals import points_in_intervals
from wardlake.session import salted_join, written
from wardlake.sources.corpus import LOCK_FILE, MANIFEST_FILE, control_files

ECOSYSTEM = "npm"

# Text of the reports.
REMEDIATION = "Review https://osv.dev/vulnerability/{id} and upgrade {name} to a patched version."
SUMMARY_LENGTH = 160
LISTED_SPECIFIERS = 5

_MANIFEST_SCHEMA = "dependencies map<string, string>, devDependencies map<string, string>"
_STRICT = {"allowSingleQuotes": "false"}
_PACKAGE_KEY = r"(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)\z"


def _is_json(content: Column) -> Column:
    return F.try_parse_json(content).isNotNull()


def _json_files(files: DataFrame, name: str) -> DataFrame:
    """A control file of every repository. Of equal keys in one object the last counts."""
    files.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return control_files(files, name)


def _locked(files: DataFrame) -> DataFrame:
    """One row per lock file with its distinct ``name NUL version`` pairs.

    A lock file is one row, so this needs no shuffle, and ``array_distinct`` on plain
    strings is hash-based.
    """
    lock = _json_files(files, LOCK_FILE).filter(_is_json(F.col("content")))
    packages = F.try_variant_get(F.try_parse_json("content"), "$.packages", "map<string, variant>")
    # every entry is read on its own, so that one that is no object is only itself left out
    pairs = F.transform(
        F.map_entries(packages),
        lambda e: F.concat(
            F.nullif(F.regexp_extract(e["key"], _PACKAGE_KEY, 1), F.lit("")),
            F.lit("\0"),
            F.nullif(F.try_variant_get(e["value"], "$.version", "string"), F.lit("")),
        ),
    )
    present = F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))
    return lock.select("repo", present.alias("pairs"))


def lock_dependencies(files: DataFrame) -> DataFrame:
    """Every installed package of a lock file at its exact version, once."""
    return (
        _locked(files)
        .select("repo", F.explode("pairs").alias("pair"))
        .select(
            "repo",
            F.substring_index("pair", "\0", 1).alias("name"),
            F.substring_index("pair", "\0", -1).alias("version"),
            F.lit("lock").alias("origin"),
        )
    )


def _declared(manifests: DataFrame) -> DataFrame:
    """Declared names with their specifier, in manifest order.

    A name keeps its first place and takes its last specifier, so development
    dependencies win. The groups are names of one manifest.
    """
    parsed = F.from_json("content", _MANIFEST_SCHEMA, _STRICT)
    entries = F.concat(
        *[
            F.coalesce(F.map_entries(parsed[part]), F.array().cast("array<struct<key:string,value:string>>"))
            for part in ("dependencies", "devDependencies")
        ]
    )
    exploded = manifests.filter(_is_json(F.col("content"))).select(
        "repo", F.posexplode_outer(entries).alias("place", "entry")
    )
    return (
        exploded.filter(F.col("entry").isNotNull())
        .groupBy("repo", F.col("entry.key").alias("name"))
        .agg(
            F.min("place").alias("place"),
            F.max_by(F.col("entry.value"), F.col("place")).alias("specifier"),
        )
        .withColumn("version", clean_version(F.col("specifier")))
    )


def _concrete(declared: DataFrame) -> DataFrame:
    return declared.filter(is_concrete_version(F.col("version"))).select(
        "repo", "name", "version", F.lit("manifest").alias("origin")
    )


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """Dependencies declared with something that cleans to a version."""
    return _concrete(_declared(_json_files(files, MANIFEST_FILE)))


def manifest_parse_errors(files: DataFrame) -> DataFrame:
    """Manifests that are no JSON; their repositories only look free of dependencies."""
    return (
        _json_files(files, MANIFEST_FILE).filter(~_is_json(F.col("content"))).select("repo", "path", "size")
    )


def _unlocked_manifests(files: DataFrame) -> DataFrame:
    with_lock = _locked(files).filter(F.size("pairs") > 0).select("repo")
    return _json_files(files, MANIFEST_FILE).join(with_lock, "repo", "left_anti")


def skipped_specifier_rows(files: DataFrame) -> DataFrame:
    """Every specifier that is no version, of repositories that rely on their manifest."""
    return (
        _declared(_unlocked_manifests(files))
        .filter(~F.coalesce(is_concrete_version(F.col("version")), F.lit(False)))
        .select("repo", "place", "name", F.coalesce("specifier", F.lit("")).alias("specifier"))
    )


def skipped_specifiers(files: DataFrame) -> DataFrame:
    """Per repository that relies on its manifest: specifiers that are no version.

    Their number and, as the text of the report, the first five in manifest order;
    ``skipped_specifier_rows`` has all. The five come from a rank with a limit, which Spark
    applies before and after the shuffle.
    """
    skipped = skipped_specifier_rows(files).withColumn("label", F.concat("name", F.lit("@"), "specifier"))
    ranked = skipped.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy("place")))
    first = ranked.filter(F.col("rank") <= LISTED_SPECIFIERS).select(
        "repo", F.lit(0).cast("bigint").alias("n"), "rank", "label"
    )
    none = F.lit(None)
    counted = skipped.groupBy("repo").agg(F.count("*").alias("n"))
    counted = counted.select(
        "repo", "n", none.cast("int").alias("rank"), none.cast("string").alias("label")
    )
    listed = F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("rank", "label"))))
    return (
        first.unionByName(counted)
        .groupBy("repo")
        .agg(F.sum("n").alias("skipped"), listed.alias("listed"))
        .select(
            "repo", "skipped", F.array_join(F.transform("listed", lambda s: s["label"]), ", ").alias("first")
        )
    )


def resolved_dependencies(files: DataFrame) -> DataFrame:
    """Locked packages, or the declared ones of repositories whose lock has none.

    ``advisory_matches`` reads the result several times; pass it through ``written`` first.
    """
    return lock_dependencies(files).unionByName(_concrete(_declared(_unlocked_manifests(files))))


def advisory_matches(dependencies: DataFrame, advisories: DataFrame, salts: int = 16) -> DataFrame:
    """Dependencies with the advisories that apply to them.

    The lookup runs once per distinct package version of the whole corpus, however many
    repositories use it. Exact version lists are an equality join. Versions and the bounds of
    ranges are sorted together once and swept, so a package with many of both costs their
    number and that of the matches. The join back to the repositories spreads popular
    packages over ``salts`` tasks.
    """
    versions = dependencies.select("name", "version").distinct()
    versions = written(versions.withColumn("key", version_key(F.col("version"))), "versions")
    known = advisories.filter(F.col("ecosystem") == ECOSYSTEM)

    listed = known.select("id", "name", F.explode("versions").alias("version")).distinct()
    exact = versions.join(listed, ["name", "version"]).select("name", "version", "id")

    ranges = known.select("id", "name", F.explode("ranges").alias("range")).select(
        "id",
        "name",
        version_key(F.col("range.introduced")).alias("introduced"),
        version_key(F.col("range.fixed")).alias("fixed"),
        version_key(F.col("range.last_affected")).alias("last_affected"),
        _unreadable(*(F.col(f"range.{bound}") for bound in ("introduced", "fixed", "last_affected"))).alias("unreadable"),
    )
    ranges = ranges.filter(~F.col("unreadable")).drop("unreadable")
    keyed = versions.filter(F.col("key").isNotNull())
    found = points_in_intervals(keyed, ranges, "name", "key", "introduced", "fixed", "last_affected", salts)
    ranged = found.select("name", "version", "interval.id")

    severity = advisory_severity(F.col("db_severity"), F.col("severity"))
    # an advisory may list a package several times; its text and rating are the advisory's
    details = known.select("id", "name", "summary", severity.alias("severity")).dropDuplicates(["id", "name"])
    matches = exact.unionByName(ranged).distinct().join(details, ["id", "name"])
    joined = salted_join(dependencies, matches, ["name", "version"], "inner", [F.col("repo")], salts)
    return joined.select("repo", "name", "version", "origin", "id", "summary", "severity")


def _unreadable(*bounds: Column) -> Column:
    """Ranges with a bound that is no version; they match nothing."""
    return reduce(operator.or_, [b.isNotNull() & version_key(b).isNull() for b in bounds])


def dependency_findings(matches: DataFrame) -> DataFrame:
    before, middle, after = REMEDIATION.replace("{name}", "{id}").split("{id}")
    id_ = F.col("id")
    release = F.concat("name", F.lit("@"), "version")
    return matches.select(
        "repo",
        F.concat(F.lit("dependency."), id_).alias("rule_id"),
        F.lit("dependency").alias("category"),
        "severity",
        F.concat(release, F.lit(": "), id_).alias("title"),
        F.lit(MANIFEST_FILE).alias("path"),
        F.lit(None).cast("int").alias("line"),
        F.coalesce(F.substring("summary", 1, SUMMARY_LENGTH), id_).alias("excerpt"),
        F.concat(F.lit(before), id_, F.lit(middle), "name", F.lit(after)).alias("remediation"),
        F.lit(1).alias("seq_phase"),
        F.lit(0).alias("seq_check"),
        F.lit(0).alias("seq_occurrence"),
        F.lit(False).alias("inline_hit"),
    )


def dependency_coverage(dependencies: DataFrame, advisories: DataFrame, salts: int = 16) -> DataFrame:
    """Per repository: how many dependencies the advisory table knows the package of."""
    known = (
        advisories.filter(F.col("ecosystem") == ECOSYSTEM)
        .select("name")
        .distinct()
        .withColumn("known", F.lit(True))
    )
    spread = [F.col("repo"), F.col("version")]
    return (
        salted_join(dependencies, known, ["name"], "left", spread, salts)
        .groupBy("repo")
        .agg(
            F.count("*").alias("dependencies"),
            F.count_if(F.col("known").isNull()).alias("unknown_packages"),
        )
    )
