"""Suppression of findings: ignore files per repository, directives per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.text import S, js_trim, split_lines
from wardlake.operators.directives import inline_directives
from wardlake.session import salted_join, written
from wardlake.sources.corpus import IGNORE_FILE, control_files

# How a finding came to be suppressed.
EXTERNAL = "external"
IN_SOURCE = "inSource"


def _rules_of(content: Column) -> Column:
    """Rules of an ignore file as structs; a null path or rule means any."""
    texts = F.filter(
        F.transform(split_lines(content), js_trim), lambda t: (t != "") & ~t.startswith("#")
    )

    def rule(text: Column) -> Column:
        tokens = F.split(text, f"{S}+", -1)
        path = F.get(tokens, F.lit(0))
        return F.struct(
            F.nullif(path, F.lit("*")).alias("ignore_path"),
            F.get(tokens, F.lit(1)).alias("ignore_rule"),
        )

    return F.transform(texts, rule)


def parse_ignore_rules(files: DataFrame) -> DataFrame:
    """Rules of every repository's ignore file, in file order."""
    ignored = control_files(files, IGNORE_FILE)
    return ignored.select("repo", F.posexplode(_rules_of(F.col("content"))).alias("place", "rule")).select(
        "repo", "place", "rule.ignore_path", "rule.ignore_rule"
    )


def _key(path: Column, rule: Column) -> Column:
    return F.concat(path, F.lit("\0"), rule)


def ignore_keys(files: DataFrame) -> DataFrame:
    """Repository and key of every ignore rule, each once.

    A rule for ``a/b`` covers the file of that name and everything below ``a/b/``; one
    that ends in a slash covers the directory only; any path is the empty string.
    """

    def keys(rule: Column) -> Column:
        path = F.coalesce(rule["ignore_path"], F.lit(""))
        covered = F.when((path == "") | path.endswith("/"), F.array(path)).otherwise(
            F.array(path, F.concat(path, F.lit("/")))
        )
        return F.transform(covered, lambda p: _key(p, F.coalesce(rule["ignore_rule"], F.lit(""))))

    listed = F.array_distinct(F.flatten(F.transform(_rules_of(F.col("content")), keys)))
    return control_files(files, IGNORE_FILE).select("repo", F.explode(listed).alias("key")).distinct()


def finding_keys(path: Column, rule_id: Column) -> Column:
    """Every key that would cover a finding: its path, directories and '' with rule or any."""
    parts = F.split(path, "/", -1)
    depth = F.size(parts) - 1
    above = F.when(
        depth > 0,
        F.transform(
            F.sequence(F.lit(1), depth),
            lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    covering = F.concat(F.array(F.lit(""), path), above)
    return F.flatten(
        F.transform(covering, lambda p: F.array(_key(p, F.lit("")), _key(p, rule_id)))
    )


def suppress_external(findings: DataFrame, files: DataFrame, salts: int = 16) -> DataFrame:
    """Findings with ``external_hit``: covered by their repository's ignore file.

    What is looked up is each distinct path and rule of a repository: its few keys (two for
    each directory of the path) meet those of the ignore file by equality, so a long ignore
    file is never carried to a finding. The findings are written once, as they are read twice.
    """
    findings = written(findings, "found")
    place = ["repo", "path", "rule_id"]
    asked = findings.select(*place).distinct().withColumn("key", F.explode(finding_keys(F.col("path"), F.col("rule_id"))))
    covered = salted_join(asked, ignore_keys(files), ["repo", "key"], "left_semi", [F.col("path"), F.col("rule_id")], salts)
    hits = covered.select(*place).distinct().withColumn("external_hit", F.lit(True))
    joined = salted_join(findings, hits, place, "left", [F.col("line"), F.col("excerpt")], salts)
    return joined.select(*findings.columns, F.coalesce("external_hit", F.lit(False)).alias("external_hit"))


def suppress_inline(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with ``inline_hit``, for findings that did not come from the scan.

    The scan sets the column itself while it sees the lines; this is the same by a join
    on file and line. A directive covers its own line and the next.
    """
    directives = inline_directives(files)
    covered = (
        directives.withColumn("line", F.explode(F.array("line_no", F.col("line_no") + 1)))
        .groupBy("repo", "path", "line")
        .agg(
            F.bool_or(F.size("rule_ids") == 0).alias("all_rules"),
            F.flatten(F.collect_list("rule_ids")).alias("named_rules"),
        )
    )
    hit = F.col("all_rules") | F.array_contains("named_rules", F.col("rule_id"))
    return (
        findings.drop("inline_hit")
        .join(covered, ["repo", "path", "line"], "left")
        .withColumn("inline_hit", F.coalesce(hit, F.lit(False)))
        .drop("all_rules", "named_rules")
    )


def apply_suppressions(findings: DataFrame, files: DataFrame, no_ignore: bool = False, salts: int = 16) -> DataFrame:
    """Findings with ``suppression_kind``; null means active. Ignore files come first."""
    if no_ignore:
        return findings.withColumn("suppression_kind", F.lit(None).cast("string"))
    kind = F.when(F.col("external_hit"), EXTERNAL).when(F.col("inline_hit"), IN_SOURCE)
    return suppress_external(findings, files, salts).withColumn("suppression_kind", kind).drop("external_hit")


def active(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("suppression_kind").isNull())


def suppressed(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("suppression_kind").isNotNull())
