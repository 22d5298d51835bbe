"""Environment files under version control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.text import base_name

# Id, title and remediation text of the report.
RULE_ID = "misconfig.committed-env-file"
TITLE = "Environment file committed to git"
REMEDIATION = (
    "Remove the file from git history (`git filter-repo --path <file> --invert-paths`), "
    "add it to .gitignore, and rotate any secrets it contained."
)


def is_env_file(path: Column) -> Column:
    """``.env`` and its variants, but no direnv script and no example or template."""
    name = base_name(path)
    return (
        name.startswith(".env")
        & (name != ".envrc")
        & ~name.rlike(r"(?i)\.(?:example|sample|template|dist)\z")
    )


def committed_env_files(tracked: DataFrame) -> DataFrame:
    """One finding per tracked environment file, wherever it lies."""
    none = F.lit(None)
    return tracked.filter(is_env_file(F.col("path"))).select(
        "repo",
        F.lit(RULE_ID).alias("rule_id"),
        F.lit("misconfig").alias("category"),
        F.lit("high").alias("severity"),
        F.lit(TITLE).alias("title"),
        "path",
        none.cast("int").alias("line"),
        none.cast("string").alias("excerpt"),
        F.lit(REMEDIATION).alias("remediation"),
        F.lit(2).alias("seq_phase"),
        F.lit(40).alias("seq_check"),
        F.lit(0).alias("seq_occurrence"),
        F.lit(False).alias("inline_hit"),
    )


def untracked_env_files(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """Environment files of the corpus that are not under version control."""
    present = files.filter(is_env_file(F.col("path"))).select("repo", "path")
    known = tracked.filter(is_env_file(F.col("path"))).select("repo", "path")
    return present.join(known, ["repo", "path"], "left_anti")
