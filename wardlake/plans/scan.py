"""The whole scan as one plan: corpus to findings with their suppression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wardlake.operators.changes import (
    BROADCAST_FILES, changed_files, dependency_gate, env_gate, fits_broadcast, only_changed, open_repos,
)
from wardlake.operators.code_rules import CODE_RULES, FALLBACK_RULES
from wardlake.operators.dependencies import advisory_matches, dependency_findings, resolved_dependencies
from wardlake.operators.docker import DOCKER_RULES
from wardlake.operators.env_files import committed_env_files
from wardlake.operators.rules import Rule, scan_lines
from wardlake.operators.secrets import SECRET_RULES
from wardlake.operators.suppression import apply_suppressions
from wardlake.operators.workflows import WORKFLOW_RULES
from wardlake.session import written
from wardlake.sources.corpus import scanned_files

DEFAULT_RULES: list[Rule] = [*SECRET_RULES, *DOCKER_RULES, *CODE_RULES, *WORKFLOW_RULES]
FALLBACK_MODE_RULES: list[Rule] = [*SECRET_RULES, *DOCKER_RULES, *FALLBACK_RULES, *WORKFLOW_RULES]


def file_counts() -> list[Column]:
    """What a scan counts of the files it reads, while it reads them."""
    kinds = {"dockerfiles": "is_dockerfile", "code_files": "is_code", "workflows": "is_workflow"}
    size = F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_scanned")
    return [F.count("*").alias("files_scanned"), size, *[F.count_if(kind).alias(name) for name, kind in kinds.items()]]


@dataclass(frozen=True)
class ScanOptions:
    skip_dependencies: bool = False
    include_test_dirs: bool = False
    exclude_dirs: tuple[str, ...] = ()
    no_ignore: bool = False
    rules: Sequence[Rule] = tuple(DEFAULT_RULES)
    max_file_bytes: int | None = None
    salts: int = 16


@dataclass(frozen=True)
class ScanResult:
    """``findings`` hold active and suppressed rows; ``scanned`` the files that were read."""

    findings: DataFrame
    scanned: DataFrame


def scan(
    files: DataFrame,
    advisories: DataFrame | None = None,
    tracked: DataFrame | None = None,
    options: ScanOptions = ScanOptions(),
    changed: DataFrame | None = None,
    observation: Observation | None = None,
) -> ScanResult:
    """Scan a corpus; with ``changed`` only the files named there.

    A restricted scan runs the dependency check for repositories with a changed
    manifest, and reports all committed environment files of those where one changed.
    Neither moves file content: a list of few changed files is broadcast, a longer one is
    compared with the findings. Files above ``max_file_bytes``, if that is set, are not scanned; ``sources.corpus.oversized``
    lists them. Dependencies are resolved once and kept in the shared folder. Set ``salts``
    to about the number of tasks that the findings of one repository should spread over.

    ``observation`` gets the numbers and bytes of files that the pass itself read (``file_counts``), so
    that totals need no second read. Unless ``no_ignore`` is set the pass runs in this call, as findings
    are written for their two uses in suppression; otherwise in the first action on them.
    """
    scanned = scanned_files(files, options.include_test_dirs, options.exclude_dirs, options.max_file_bytes)
    few = changed is not None and fits_broadcast(changed.select("repo", "path"), BROADCAST_FILES)
    if few:
        scanned = only_changed(scanned, changed, few)
    findings = scan_lines(scanned if observation is None else scanned.observe(observation, *file_counts()), options.rules)
    if changed is not None and not few:
        # scanning all files costs less than moving the text of a large part of them
        scanned, findings = only_changed(scanned.drop("content"), changed), only_changed(findings, changed)
    if advisories is not None and not options.skip_dependencies:
        dependencies = resolved_dependencies(files)
        if changed is not None:
            dependencies = open_repos(dependencies, dependency_gate(changed), "name")
        matches = advisory_matches(written(dependencies, "dependencies"), advisories, options.salts)
        findings = findings.unionByName(dependency_findings(matches))
    if tracked is not None:
        paths = tracked if changed is None else open_repos(tracked, env_gate(changed), "path")
        findings = findings.unionByName(committed_env_files(paths))
    return ScanResult(apply_suppressions(findings, files, options.no_ignore, options.salts), scanned)


def diff_scan(
    base: DataFrame,
    head: DataFrame,
    advisories: DataFrame | None = None,
    tracked: DataFrame | None = None,
    options: ScanOptions = ScanOptions(),
) -> ScanResult:
    """Scan what changed from one snapshot of a corpus to another.

    The changes are compared once and kept in the shared folder for their several uses.
    """
    return scan(head, advisories, tracked, options, written(changed_files(base, head), "changed"))
