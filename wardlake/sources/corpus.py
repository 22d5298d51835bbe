"""The corpus: file rows, and the filters that decide which of them are scanned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.functions.text import base_name, directories, extension, split_lines
from wardlake.session import setting
from wardlake.sources.tree import walk_tree

# Directories that never hold sources of their own.
ALWAYS_SKIPPED = ("node_modules", ".git", "dist", "build", "coverage", ".next", ".cache")

# Directories of test and example code, skipped unless asked for.
NON_PRODUCTION = (
    "test", "tests", "__tests__", "spec", "specs", "examples", "example", "demo", "demos",
    "sample", "samples", "fixtures", "__mocks__", "mocks", "stubs", "e2e",
)

# Extensions that are read.
SCANNED_EXTENSIONS = (
    ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".json", ".env", ".yml", ".yaml", ".sh",
)

# Fixed value: the limit that a scan may set; it has none by itself.
MAX_FILE_BYTES = 1_000_000

# Files at a repository's root that steer the scan.
LOCK_FILE = "package-lock.json"
MANIFEST_FILE = "package.json"
IGNORE_FILE = ".scannerignore"
CONTROL_FILES = (LOCK_FILE, MANIFEST_FILE, IGNORE_FILE)

ROLES = ("control", "source", "other")


def read_tree(
    spark: SparkSession, root: str, repo: str | None = None, skip_dirs: list[str] | tuple[str, ...] = ALWAYS_SKIPPED
) -> DataFrame:
    """File rows below a directory, also of names that begin with a dot or an underscore.

    ``repo`` names the one repository at ``root``; without it every first-level directory
    is a repository. Directories named in ``skip_dirs`` are not entered and links are not
    followed. ``unreadable`` lists the files that this leaves out because they can't be read.
    """
    return walk_tree(spark, root, repo, skip_dirs).filter("error IS NULL").drop("error")


def unreadable(
    spark: SparkSession, root: str, repo: str | None = None, skip_dirs: list[str] | tuple[str, ...] = ALWAYS_SKIPPED
) -> DataFrame:
    """What ``read_tree`` couldn't read, and why: repo, path, error."""
    return walk_tree(spark, root, repo, skip_dirs).filter("error IS NOT NULL").select("repo", "path", "error")


def file_rows(table: DataFrame, repo: Column, path: Column, content: Column) -> DataFrame:
    """File rows from any table that holds texts."""
    return table.select(
        repo.alias("repo"),
        path.alias("path"),
        F.octet_length(content).cast("long").alias("size"),
        content.alias("content"),
    )


def write_corpus(files: DataFrame, target: str, mode: str = "errorifexists") -> None:
    """Store a corpus so that later jobs read only what they need.

    ``role`` is a partition column: files that are never scanned are never opened, and
    the dependency and suppression steps open the small ``control`` part only. With
    ``content_hash`` snapshots are compared without reading texts. A task writes the roles
    side by side, so that whole texts need no sort by role, which would spill them.
    """
    role = (
        F.when(F.col("path").isin(*CONTROL_FILES), "control")
        .when(is_scannable(F.col("path")), "source")
        .otherwise("other")
    )
    hashed = files if "content_hash" in files.columns else files.withColumn("content_hash", F.sha2("content", 256))
    with setting(files.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(len(ROLES))):
        hashed.withColumn("role", role).write.mode(mode).partitionBy("role").parquet(target)


def read_corpus(spark: SparkSession, source: str) -> DataFrame:
    return spark.read.parquet(source)


def control_files(files: DataFrame, *names: str) -> DataFrame:
    """Root-level files by name, from the ``control`` partition where there is one."""
    chosen = files.filter(F.col("path").isin(*names))
    return chosen.filter("role = 'control'") if "role" in files.columns else chosen


def skipped_directories(
    include_test_dirs: bool = False, exclude_dirs: list[str] | tuple[str, ...] = ()
) -> list[str]:
    extra = [d.strip() for d in exclude_dirs]
    return [*ALWAYS_SKIPPED, *(() if include_test_dirs else NON_PRODUCTION), *extra]


def prune_directories(files: DataFrame, skipped: list[str]) -> DataFrame:
    """Drop files below a directory with one of these exact names, at any depth."""
    names = F.array(*map(F.lit, skipped))
    return files.filter(~F.arrays_overlap(directories(F.col("path")), names))


def is_dockerfile(path: Column) -> Column:
    name = F.lower(base_name(path))
    return (name == "dockerfile") | name.startswith("dockerfile.") | (extension(path) == ".dockerfile")


def is_workflow(path: Column) -> Column:
    return path.startswith(".github/workflows/") & extension(path).isin(".yml", ".yaml")


def is_code(path: Column) -> Column:
    last = F.substring_index(path, ".", -1)
    return path.contains(".") & last.isin("js", "jsx", "ts", "tsx", "mjs", "cjs") & ~is_dockerfile(path)


def is_scannable(path: Column) -> Column:
    return (
        extension(path).isin(*SCANNED_EXTENSIONS)
        | base_name(path).startswith(".env")
        | is_dockerfile(path)
    )


def scannable(files: DataFrame) -> DataFrame:
    return files.filter(is_scannable(F.col("path")))


def within_size(files: DataFrame, limit: int | None = MAX_FILE_BYTES) -> DataFrame:
    return files if limit is None else files.filter(F.col("size") <= limit)


def oversized(files: DataFrame, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """The files that a scan with this limit leaves out, without their content."""
    return scannable(files).filter(F.col("size") > limit).select("repo", "path", "size")


def route(files: DataFrame) -> DataFrame:
    """Add which rule families apply: ``is_dockerfile``, ``is_code``, ``is_workflow``."""
    path = F.col("path")
    return files.withColumns(
        {
            "is_dockerfile": is_dockerfile(path),
            "is_code": is_code(path),
            "is_workflow": is_workflow(path),
        }
    )


def scanned_files(
    files: DataFrame,
    include_test_dirs: bool = False,
    exclude_dirs: list[str] | tuple[str, ...] = (),
    max_file_bytes: int | None = None,
) -> DataFrame:
    """The files a scan reads, with their routing."""
    kept = files.filter("role <> 'other'") if "role" in files.columns else files
    kept = prune_directories(kept, skipped_directories(include_test_dirs, exclude_dirs))
    return route(within_size(scannable(kept), max_file_bytes))


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1. Narrow: lines never leave their file's task."""
    return files.select(
        "repo", "path", F.posexplode_outer(split_lines(F.col("content"))).alias("position", "line")
    ).select("repo", "path", (F.col("position") + 1).alias("line_no"), "line")
