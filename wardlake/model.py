"""Schemas, severities and the columns every operator agrees on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities, weakest first.
SEVERITIES = ("info", "low", "medium", "high", "critical")

FILES_SCHEMA = "repo string, path string, size long, content string"

FINDINGS_SCHEMA = (
    "repo string, rule_id string, category string, severity string, title string, "
    "path string, line int, excerpt string, remediation string, "
    "seq_phase int, seq_check int, seq_occurrence int, inline_hit boolean"
)

ADVISORIES_SCHEMA = (
    "id string, ecosystem string, name string, summary string, db_severity string, "
    "severity array<struct<type string, score string>>, versions array<string>, "
    "ranges array<struct<introduced string, fixed string, last_affected string>>"
)

FINDING_COLUMNS = (
    "repo",
    "rule_id",
    "category",
    "severity",
    "title",
    "path",
    "line",
    "excerpt",
    "remediation",
)

# A finding's place in its repository: content checks (0), then dependencies (1),
# then committed environment files (2); inside a phase by path, check, line and
# occurrence. It only decides ties, so it never has to be one global number.
ORDER_COLUMNS = ("seq_phase", "path", "seq_check", "line", "seq_occurrence", "rule_id")


def order_key(*first: Column) -> list[Column]:
    """Sort columns of a finding's place, lines before line-less findings."""
    keys = [F.col(c).asc_nulls_last() for c in ORDER_COLUMNS]
    return [*first, *keys]


def order_struct() -> Column:
    """The same order as one comparable struct, for ``min_by`` and friends."""
    line = F.coalesce("line", F.lit(2**31 - 1)).alias("line")
    return F.struct(*[line if c == "line" else F.col(c) for c in ORDER_COLUMNS])


def check_severity(name: str) -> str:
    if name not in SEVERITIES:
        raise ValueError(f"unknown severity {name!r}; expected one of: {' | '.join(SEVERITIES)}")
    return name


def severity_rank(severity: Column) -> Column:
    """0 for info up to 4 for critical; -1 for anything else."""
    return (F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1).cast("int")


def severity_at_least(findings: DataFrame, threshold: str) -> DataFrame:
    rank = SEVERITIES.index(check_severity(threshold))
    return findings.filter(severity_rank(F.col("severity")) >= rank)


def public(findings: DataFrame, *more: str) -> DataFrame:
    """A findings table without its ordering and bookkeeping columns, but with those named in ``more``."""
    extra = [c for c in ("suppression_kind", *more) if c in findings.columns]
    return findings.select(*FINDING_COLUMNS, *extra)
