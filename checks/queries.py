"""Every registered query: the operators over the planted corpus and the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from checks import planted as P
from wardlake.functions.cvss import advisory_severity, cvss_base_score
from wardlake.functions.code import HIDDEN, code_text, without_marks
from wardlake.functions.text import mask_code
from wardlake.model import public, severity_at_least
from wardlake.operators import changes, code_rules, dependencies, docker, env_files, exec_calls, secrets
from wardlake.operators import suppression as S
from wardlake.operators import workflows
from wardlake.operators.directives import inline_directives
from wardlake.operators.rules import Rule, pattern_rule, scan_lines
from wardlake.plans import report
from wardlake.plans.scan import ScanOptions, ScanResult, diff_scan, scan
from wardlake.session import shared_folder, written
from wardlake.sources import corpus as C
from wardlake.sources.advisories import read_advisories
from wardlake.streaming.incremental import read_arrivals, scan_stream, store_findings

Query = Callable[[SparkSession, str], DataFrame]

# What a user might add: a rule of their own, one finding per line.
CUSTOM_RULE = pattern_rule(
    "custom.fixme-or-amount",
    "misconfig",
    "info",
    "Amount or unfinished note",
    "Resolve the note or move the amount to configuration.",
    r"(?i)\b(?:fixme|todo)\b|[0-9]{4,}",
    per_line=True,
    check_order=50,
)


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted corpus and the given texts as they are."""
    return P.corpus(spark, sf_dir).unionByName(P.texts(spark, sf_dir))


def full_scan(spark: SparkSession, sf_dir: str, **options) -> ScanResult:
    return scan(
        P.corpus(spark, sf_dir),
        P.advisories(spark, sf_dir),
        P.tracked(spark, sf_dir),
        ScanOptions(**options),
    )


def stored_scan(spark: SparkSession, sf_dir: str) -> ScanResult:
    """The full scan with its findings written once, for reports that read them often."""
    result = full_scan(spark, sf_dir)
    return replace(result, findings=written(result.findings, "findings"))


def rule_query(rules: Sequence[Rule]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return public(scan_lines(C.scanned_files(all_files(spark, sf_dir)), rules))

    return query


def corpus_files(spark, sf_dir):
    return all_files(spark, sf_dir).select("repo", "path", "size", F.sha2("content", 256).alias("digest"))


def filter_excluded_dirs(spark, sf_dir):
    return C.prune_directories(all_files(spark, sf_dir), C.skipped_directories()).select("repo", "path")


def filter_custom_excludes(spark, sf_dir):
    skipped = C.skipped_directories(exclude_dirs=["vendor", " lib "])
    return C.prune_directories(all_files(spark, sf_dir), skipped).select("repo", "path")


def include_test_dirs(spark, sf_dir):
    skipped = C.skipped_directories(include_test_dirs=True)
    return C.prune_directories(all_files(spark, sf_dir), skipped).select("repo", "path")


def filter_scannable(spark, sf_dir):
    return C.scannable(all_files(spark, sf_dir)).select("repo", "path")


def route_file_kind(spark, sf_dir):
    flags = ("is_dockerfile", "is_code", "is_workflow")
    return C.route(all_files(spark, sf_dir)).select("repo", "path", *flags)


def filter_max_size(spark, sf_dir):
    return C.within_size(all_files(spark, sf_dir)).select("repo", "path", "size")


def explode_lines(spark, sf_dir):
    return C.explode_lines(C.scanned_files(all_files(spark, sf_dir)))


def mask_code_lines(spark, sf_dir):
    code = C.scanned_files(all_files(spark, sf_dir)).filter("is_code")
    return C.explode_lines(code).select("repo", "path", "line_no", mask_code(F.col("line")).alias("masked"))


#: Planted sources whose masked text the checks state in full.
STATED = r"^(src/(eval|ns|tpl)\d+\.js|src/f\d+\.ts|lib/f\d+\.js)$"


def masked_sources(spark, sf_dir):
    """Lines of code that are left of sources that close; hidden strings are empty, hidden text of templates is one #."""
    files = C.scanned_files(P.corpus(spark, sf_dir)).filter(F.col("is_code") & F.col("path").rlike(STATED))
    code = files.select("repo", "path", code_text(F.col("content")).alias("code")).filter("code.whole")
    strings = F.regexp_replace(without_marks(F.col("code.text")), f'"([^"{HIDDEN}]*)"|"[^"]*"', '"$1"')
    text = F.regexp_replace(strings, f"{HIDDEN}+", "#")
    lines = code.select("repo", "path", F.posexplode(F.split(text, "\n", -1)).alias("place", "line"))
    return lines.select("repo", "path", (F.col("place") + 1).alias("line_no"), F.trim("line").alias("code")).filter("code <> ''")


def exec_bindings(spark, sf_dir):
    return exec_calls.exec_bindings(C.scanned_files(all_files(spark, sf_dir)))


def docker_stages(spark, sf_dir):
    return docker.docker_stages(C.scanned_files(P.corpus(spark, sf_dir)))


def committed_env_files(spark, sf_dir):
    return public(env_files.committed_env_files(P.tracked(spark, sf_dir)))


def untracked_env_files(spark, sf_dir):
    return env_files.untracked_env_files(P.corpus(spark, sf_dir), P.tracked(spark, sf_dir))


def of_dependency_files(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(P.corpus(spark, sf_dir))


def cvss_scores(spark, sf_dir):
    vectors = P.cvss_vectors(spark, sf_dir)
    return vectors.withColumn("base_score", cvss_base_score(F.col("vector")))


def advisory_severities(spark, sf_dir):
    rows = P.advisories(spark, sf_dir)
    return rows.select("id", advisory_severity(F.col("db_severity"), F.col("severity")).alias("severity")).distinct()


def tree_files(spark, sf_dir):
    """The planted files, written out as directories and read back."""
    rows = C.read_tree(spark, P.tree(spark, sf_dir), skip_dirs=())
    return rows.select("repo", "path", "size", F.sha2("content", 256).alias("digest"))


def oversized_files(spark, sf_dir):
    return C.oversized(all_files(spark, sf_dir))


def _matches(spark, sf_dir):
    resolved = dependencies.resolved_dependencies(P.corpus(spark, sf_dir))
    return dependencies.advisory_matches(resolved, P.advisories(spark, sf_dir))


def advisory_matches(spark, sf_dir):
    return _matches(spark, sf_dir).select("repo", "name", "version", "origin", "id")


def dependency_findings(spark, sf_dir):
    return public(dependencies.dependency_findings(_matches(spark, sf_dir)))


def dependency_coverage(spark, sf_dir):
    resolved = dependencies.resolved_dependencies(P.corpus(spark, sf_dir))
    return dependencies.dependency_coverage(resolved, P.advisories(spark, sf_dir))


def parse_ignore_rules(spark, sf_dir):
    return S.parse_ignore_rules(P.corpus(spark, sf_dir))


def directives(spark, sf_dir):
    rows = inline_directives(C.scanned_files(P.corpus(spark, sf_dir)))
    return rows.withColumn("rule_ids", F.array_join("rule_ids", ","))


def _line_findings(spark, sf_dir):
    files = P.corpus(spark, sf_dir)
    return scan_lines(C.scanned_files(files), ScanOptions().rules), files


def suppress_external(spark, sf_dir):
    findings, files = _line_findings(spark, sf_dir)
    hits = S.suppress_external(findings, files).filter("external_hit")
    return hits.select("repo", "rule_id", "path", "line", "excerpt")


def suppress_inline(spark, sf_dir):
    findings, files = _line_findings(spark, sf_dir)
    hits = S.suppress_inline(findings, C.scanned_files(files)).filter("inline_hit")
    return hits.select("repo", "rule_id", "path", "line", "excerpt")


def apply_suppressions(spark, sf_dir):
    findings, files = _line_findings(spark, sf_dir)
    return public(S.apply_suppressions(findings, files))


def no_ignore(spark, sf_dir):
    findings, files = _line_findings(spark, sf_dir)
    return public(S.apply_suppressions(findings, files, no_ignore=True))


def suppressed_findings(spark, sf_dir):
    return public(S.suppressed(full_scan(spark, sf_dir).findings))


def changed_files(spark, sf_dir):
    return changes.changed_files(*P.snapshots(spark, sf_dir))


def changed_files_by_digest(spark, sf_dir):
    """The same changes, from directories whose stored digests differ only."""
    base, head = P.snapshots(spark, sf_dir)
    before, after = (written(changes.folder_digests(side), "digests") for side in (base, head))
    return changes.changed_files_within(base, head, written(changes.changed_folders(before, after), "folders"))


def changed_files_scan(spark, sf_dir):
    base, head = P.snapshots(spark, sf_dir)
    return public(diff_scan(base, head, P.advisories(spark, sf_dir), P.tracked(spark, sf_dir)).findings)


def advisory_records(spark, sf_dir):
    """Matches of advisories that are read from records in the published JSON format."""
    known = read_advisories(spark, P.advisory_records(spark, sf_dir), multi_line=False)
    matches = dependencies.advisory_matches(dependencies.resolved_dependencies(P.corpus(spark, sf_dir)), known)
    return matches.select("repo", "name", "version", "origin", "id")


def stream_findings(spark, sf_dir):
    """Findings of the planted files as they arrive in a stream, some twice and some late."""
    target = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    arrivals = read_arrivals(spark, P.arrivals(spark, sf_dir))
    store_findings(scan_stream(arrivals), f"{target}/findings", f"{target}/checkpoint").awaitTermination()
    return public(spark.read.parquet(f"{target}/findings"), "in_source")


def diff_dependency_gate(spark, sf_dir):
    return changes.dependency_gate(changed_files(spark, sf_dir))


def diff_env_gate(spark, sf_dir):
    return changes.env_gate(changed_files(spark, sf_dir))


def all_findings(spark, sf_dir):
    return public(full_scan(spark, sf_dir).findings)


def scan_texts(spark, sf_dir):
    options = ScanOptions(rules=(*ScanOptions().rules, secrets.GENERIC_TOKEN))
    return public(scan(P.texts(spark, sf_dir), options=options).findings)


def skip_dependencies(spark, sf_dir):
    return public(full_scan(spark, sf_dir, skip_dependencies=True, include_test_dirs=True).findings)


def findings_at_least(spark, sf_dir):
    return public(severity_at_least(full_scan(spark, sf_dir).findings, "high"))


def severity_counts(spark, sf_dir):
    return report.severity_counts(full_scan(spark, sf_dir).findings)


def findings_rollup(spark, sf_dir):
    return report.findings_rollup(full_scan(spark, sf_dir).findings)


def scan_summary(spark, sf_dir):
    result = full_scan(spark, sf_dir)
    return report.scan_summary(result.findings, result.scanned)


def scan_totals(spark, sf_dir):
    """Files and bytes of a scan, counted by the pass that finds."""
    counts = Observation("scan")
    corpus = P.corpus(spark, sf_dir)
    written(scan(corpus, observation=counts).findings, "findings")
    names = ("files_scanned", "bytes_scanned", "dockerfiles", "code_files", "workflows")
    return spark.range(1).select(*[F.lit(counts.get[n]).cast("long").alias(n) for n in names])


def fail_on(spark, sf_dir):
    result = full_scan(spark, sf_dir)
    return report.fail_on(result.findings, result.scanned, "critical")


def finding_fingerprints(spark, sf_dir):
    rows = report.with_fingerprints(full_scan(spark, sf_dir).findings)
    return rows.select("repo", "rule_id", "path", "line", "title", "fingerprint")


def sarif_rules(spark, sf_dir):
    return report.sarif_rules(full_scan(spark, sf_dir).findings).drop("place")


def sarif_results(spark, sf_dir):
    return report.sarif_results(full_scan(spark, sf_dir).findings).drop("place")


def sarif_document(spark, sf_dir):
    result = stored_scan(spark, sf_dir)
    return report.ordered(report.sarif_document(result.findings, result.scanned)).select("repo", "section", "text")


def json_report(spark, sf_dir):
    result = stored_scan(spark, sf_dir)
    fragments = report.json_report(result.findings, result.scanned)
    return report.ordered(fragments).select("repo", "section", "text")


def findings_report(spark, sf_dir):
    return report.findings_report(full_scan(spark, sf_dir).findings)


def report_summary(spark, sf_dir):
    return report.summary_lines(scan_summary(spark, sf_dir))


SINGLE_RULES = {
    "secret_aws_access_key": secrets.AWS_ACCESS_KEY,
    "secret_private_key": secrets.PRIVATE_KEY,
    "secret_api_key": secrets.API_KEY,
    "secret_jwt_secret": secrets.JWT_SECRET,
    "secret_bearer_token": secrets.BEARER_TOKEN,
    "secret_hardcoded_password": secrets.HARDCODED_PASSWORD,
    "secret_generic_token": secrets.GENERIC_TOKEN,
    "misconfig_eval": code_rules.EVAL,
    "misconfig_new_function": code_rules.NEW_FUNCTION,
    "exec_binding_calls": code_rules.EXEC,
    "misconfig_tls": code_rules.TLS,
    "misconfig_cors": code_rules.CORS,
    "misconfig_weak_random": code_rules.WEAK_RANDOM,
    "misconfig_insecure_http": code_rules.INSECURE_HTTP,
    "misconfig_eval_fallback": code_rules.EVAL_FALLBACK,
    "misconfig_new_function_fallback": code_rules.NEW_FUNCTION_FALLBACK,
    "misconfig_exec_fallback": code_rules.EXEC_FALLBACK,
    "misconfig_tls_fallback": code_rules.TLS_FALLBACK,
    "misconfig_cors_fallback": code_rules.CORS_FALLBACK,
    "misconfig_weak_random_fallback": code_rules.WEAK_RANDOM_FALLBACK,
    "docker_latest_tag": docker.LATEST_TAG,
    "docker_root_user": docker.ROOT_USER,
    "docker_env_secret": docker.ENV_SECRET,
    "gha_unpinned_action": workflows.UNPINNED_ACTION,
    "gha_pwn_request": workflows.PWN_REQUEST,
    "custom_rules": CUSTOM_RULE,
}

RULE_GROUPS = {
    "secret_findings": [*secrets.SECRET_RULES, secrets.GENERIC_TOKEN],
    "misconfig_findings": code_rules.CODE_RULES,
    "misconfig_findings_fallback": code_rules.FALLBACK_RULES,
    "dockerfile_findings": docker.DOCKER_RULES,
    "gha_findings": workflows.WORKFLOW_RULES,
}

QUERIES: dict[str, Query] = {
    "corpus_files": corpus_files,
    "filter_excluded_dirs": filter_excluded_dirs,
    "filter_custom_excludes": filter_custom_excludes,
    "include_test_dirs": include_test_dirs,
    "filter_scannable": filter_scannable,
    "route_file_kind": route_file_kind,
    "filter_max_size": filter_max_size,
    "explode_lines": explode_lines,
    "mask_code_lines": mask_code_lines,
    "masked_sources": masked_sources,
    **{key: rule_query([rule]) for key, rule in SINGLE_RULES.items()},
    **{key: rule_query(rules) for key, rules in RULE_GROUPS.items()},
    "exec_bindings": exec_bindings,
    "docker_stages": docker_stages,
    "committed_env_files": committed_env_files,
    "untracked_env_files": untracked_env_files,
    "lock_dependencies": of_dependency_files(dependencies.lock_dependencies),
    "manifest_dependencies": of_dependency_files(dependencies.manifest_dependencies),
    "manifest_parse_errors": of_dependency_files(dependencies.manifest_parse_errors),
    "skipped_specifiers": of_dependency_files(dependencies.skipped_specifiers),
    "skipped_specifier_rows": of_dependency_files(lambda files: dependencies.skipped_specifier_rows(files).drop("place")),
    "advisory_records": advisory_records,
    "stream_findings": stream_findings,
    "oversized_files": oversized_files,
    "tree_files": tree_files,
    "resolved_dependencies": of_dependency_files(dependencies.resolved_dependencies),
    "cvss_base_score": cvss_scores,
    "advisory_severity": advisory_severities,
    "advisory_matches": advisory_matches,
    "dependency_findings": dependency_findings,
    "dependency_coverage": dependency_coverage,
    "parse_ignore_rules": parse_ignore_rules,
    "inline_directives": directives,
    "suppress_external": suppress_external,
    "suppress_inline": suppress_inline,
    "apply_suppressions": apply_suppressions,
    "apply_suppressions_no_ignore": no_ignore,
    "suppressed_findings": suppressed_findings,
    "changed_files": changed_files,
    "changed_files_by_digest": changed_files_by_digest,
    "diff_scan": changed_files_scan,
    "diff_dependency_gate": diff_dependency_gate,
    "diff_env_gate": diff_env_gate,
    "all_findings": all_findings,
    "scan_texts": scan_texts,
    "skip_dependencies": skip_dependencies,
    "severity_at_least": findings_at_least,
    "severity_counts": severity_counts,
    "findings_rollup": findings_rollup,
    "scan_summary": scan_summary,
    "scan_totals": scan_totals,
    "fail_on": fail_on,
    "finding_fingerprints": finding_fingerprints,
    "sarif_rules": sarif_rules,
    "sarif_results": sarif_results,
    "sarif_document": sarif_document,
    "json_report": json_report,
    "findings_report": findings_report,
    "report_summary": report_summary,
}
