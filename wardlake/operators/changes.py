"""What changed between two snapshots of a corpus, and what that calls for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.text import base_name
from wardlake.session import salted_join

# Files whose change calls for a new dependency check.
MANIFEST_NAMES = (
    "package.json",
    "package-lock.json",
    "npm-shrinkwrap.json",
    "yarn.lock",
    "pnpm-lock.yaml",
)


#: Names (of changed files or directories) that are broadcast, at most, and their bytes.
BROADCAST_FILES = 1_000_000
BROADCAST_BYTES = 100_000_000


def fits_broadcast(names: DataFrame, most: int = BROADCAST_FILES) -> bool:
    """Whether there are no more rows of names than ``most`` and no more bytes in them than BROADCAST_BYTES."""
    length = sum((F.coalesce(F.octet_length(c).cast("long"), F.lit(0)) for c in names.columns), F.lit(0))
    rows, size = names.select(length.alias("length")).limit(most + 1).agg(F.count("*"), F.sum("length")).first()
    return rows <= most and (size or 0) <= BROADCAST_BYTES


def _digests(files: DataFrame, side: int) -> DataFrame:
    digest = (
        F.col("content_hash") if "content_hash" in files.columns else F.sha2("content", 256)
    )
    return files.select("repo", "path", F.lit(side).alias("side"), digest.alias("digest"))


def changed_files(base: DataFrame, head: DataFrame) -> DataFrame:
    """Files that were added, modified or deleted.

    Only digests are shuffled, and one aggregation does the work of a full outer join.
    Snapshots that carry a ``content_hash`` column are compared without reading texts.
    """
    both = _digests(base, 0).unionByName(_digests(head, 1))
    before = F.max(F.when(F.col("side") == 0, F.col("digest")))
    after = F.max(F.when(F.col("side") == 1, F.col("digest")))
    change = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "deleted")
        .when(F.col("before") != F.col("after"), "modified")
    )
    return (
        both.groupBy("repo", "path")
        .agg(before.alias("before"), after.alias("after"))
        .select("repo", "path", change.alias("change"))
        .filter(F.col("change").isNotNull())
    )


def folder_digests(files: DataFrame) -> DataFrame:
    """One digest per repository and first-level directory (``folder``, empty for files at the root).

    Two 60-bit sums over hashes of path and content: equal for equal sets of files in any
    order, and added up in tasks before anything is shuffled. Store it beside the corpus.
    """
    first = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise("")
    mark = F.sha2(F.concat("path", F.lit("\0"), F.coalesce("digest", F.lit("\1"))), 256)

    def part(start: int) -> Column:
        return F.conv(F.substring("mark", start, 15), 16, 10).cast("decimal(20,0)")

    marked = _digests(files, 0).select("repo", first.alias("folder"), mark.alias("mark"))
    sums = [F.count("*").cast("string"), *[F.sum(part(start)).cast("string") for start in (1, 16)]]
    return marked.groupBy("repo", "folder").agg(F.concat_ws(":", *sums).alias("folder_digest"))


def changed_folders(base_digests: DataFrame, head_digests: DataFrame) -> DataFrame:
    """First-level directories (repo, folder) that differ between two tables of ``folder_digests``."""
    both = base_digests.withColumn("side", F.lit(0)).unionByName(head_digests.withColumn("side", F.lit(1)))
    digests = [F.max(F.when(F.col("side") == side, F.col("folder_digest"))) for side in (0, 1)]
    differ = both.groupBy("repo", "folder").agg((~digests[0].eqNullSafe(digests[1])).alias("differs"))
    return differ.filter("differs").drop("differs")


def changed_files_within(base: DataFrame, head: DataFrame, folders: DataFrame) -> DataFrame:
    """``changed_files`` of two snapshots where only these directories (of ``changed_folders``) can differ.

    Rows of other directories are left where they are read: few directories (``fits_broadcast``)
    are sent to the readers, more are joined, with rows of a hot directory dealt over tasks.
    """
    few = fits_broadcast(folders, BROADCAST_FILES)

    def within(files: DataFrame) -> DataFrame:
        first = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise("")
        rows = _digests(files, 0).select("repo", "path", F.col("digest").alias("content_hash")).withColumn("folder", first)
        if few:
            return rows.join(F.broadcast(folders), ["repo", "folder"], "left_semi")
        return salted_join(rows, folders, ["repo", "folder"], "left_semi", [F.col("path")])

    return changed_files(within(base), within(head))



def only_changed(rows: DataFrame, changed: DataFrame, few: bool = False) -> DataFrame:
    """The rows (files, or findings in them) of the head snapshot whose file changed.

    ``few`` says that the names of the changed files fit a broadcast; they are then
    broadcast and the rows are not moved. Otherwise pass rows without content.
    """
    names = changed.select("repo", "path")
    return rows.join(F.broadcast(names) if few else names, ["repo", "path"], "left_semi")


def dependency_gate(changed: DataFrame) -> DataFrame:
    """Repositories in which a manifest or lock file changed, in any directory."""
    return changed.filter(base_name(F.col("path")).isin(*MANIFEST_NAMES)).select("repo").distinct()


def env_gate(changed: DataFrame) -> DataFrame:
    """Repositories in which an environment file changed."""
    return changed.filter(base_name(F.col("path")).startswith(".env")).select("repo").distinct()


def open_repos(rows: DataFrame, gate: DataFrame, spread: str) -> DataFrame:
    """Rows of the repositories a gate lets through; ``spread`` splits a hot repository."""
    return salted_join(rows, gate, ["repo"], "left_semi", [F.col(spread)])
