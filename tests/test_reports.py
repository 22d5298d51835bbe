"""Fingerprints, summaries and documents."""

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import Observation

from wardlake.model import SEVERITIES, severity_at_least
from wardlake.plans import report
from wardlake.plans.scan import ScanOptions, scan
from wardlake.session import written

FILES = {
    "src/a.js": "eval(x)\neval(x)\n  eval(  x )\nconst token = Math.random();",
    "src/b.js": "f('http://a.b'); // scanner-ignore\neval(y) // scanner-ignore",
    "Dockerfile": "FROM a:1",
    ("quiet", "a.js"): "f()",
}


@pytest.fixture(scope="module")
def result(spark, corpus_of):
    r = scan(corpus_of(FILES))
    return written(r.findings, "t"), r.scanned


def document(fragments, repo):
    rows = report.ordered(fragments).filter(f"repo = '{repo}'").collect()
    return json.loads("".join(r.text for r in rows))


def test_fingerprints(result):
    rows = report.with_fingerprints(result[0]).collect()
    prints = {(r.path, r.line, r.rule_id): r.fingerprint for r in rows}
    base = hashlib.sha256(b"misconfig.eval\0src/a.js\0eval(x)").hexdigest()[:16]
    assert prints[("src/a.js", 1, "misconfig.eval")] == base + ":0"
    assert prints[("src/a.js", 2, "misconfig.eval")] == base + ":1"
    spaced = hashlib.sha256(b"misconfig.eval\0src/a.js\0eval( x )").hexdigest()[:16]
    assert prints[("src/a.js", 3, "misconfig.eval")] == spaced
    assert len(set(prints.values())) == len(rows)


def test_fingerprint_survives_a_move(corpus_of):
    def prints(text):
        findings = scan(corpus_of({"a.js": text})).findings
        return {r.fingerprint for r in report.with_fingerprints(findings).collect()}

    assert prints("eval(x)") == prints("\n\n// moved\n   eval(x)  ")


def test_sarif(result):
    doc = document(report.sarif_document(*result), "r")
    assert doc["version"] == "2.1.0" and len(doc["runs"]) == 1
    run = doc["runs"][0]
    assert [r["ruleId"] for r in run["results"]].count("misconfig.eval") == 4
    rules = {r["id"]: r for r in run["tool"]["driver"]["rules"]}
    assert set(rules) == {r["ruleId"] for r in run["results"]}
    assert rules["misconfig.eval"]["properties"] == {
        "category": "misconfig", "security-severity": "8.0", "tags": ["security", "misconfig"]
    }
    assert rules["misconfig.weak-random"]["defaultConfiguration"] == {"level": "warning"}
    root_user = next(r for r in run["results"] if r["ruleId"] == "misconfig.dockerfile-root-user")
    assert "region" not in root_user["locations"][0]["physicalLocation"]
    assert root_user["message"]["text"] == "Container runs as root"
    hidden = [r for r in run["results"] if "suppressions" in r]
    assert [h["suppressions"] for h in hidden] == [[{"kind": "inSource", "status": "accepted"}]] * 2
    assert run["results"][-2:] == hidden
    empty = document(report.sarif_document(*result), "quiet")
    assert empty["runs"][0]["results"] == [] and empty["runs"][0]["tool"]["driver"]["rules"] == []


def test_json_report(result):
    doc = document(report.json_report(*result, started_at="2026-01-01T00:00:00Z"), "r")
    assert (doc["root"], doc["filesScanned"], doc["suppressedCount"]) == ("r", 3, 2)
    assert doc["startedAt"] == "2026-01-01T00:00:00Z" and "finishedAt" not in doc
    assert len(doc["findings"]) == 5 and len(doc["suppressedFindings"]) == 2
    assert "line" not in doc["findings"][0] and doc["findings"][0]["ruleId"] == "misconfig.dockerfile-root-user"
    assert {f["suppressionKind"] for f in doc["suppressedFindings"]} == {"inSource"}


def test_written_documents_are_whole(result, tmp_path):
    target = tmp_path / "sarif"
    report.write_documents(report.sarif_document(*result), str(target))
    for repo in ("r", "quiet"):
        parts = sorted(Path(target, f"repo={repo}").glob("part-*.txt"))
        assert json.loads("".join(p.read_text() for p in parts)) == document(report.sarif_document(*result), repo)


def test_summary_and_gate(result):
    rows = {r.repo: r for r in report.scan_summary(*result).collect()}
    assert (rows["r"].files_scanned, rows["r"].findings, rows["r"].suppressed, rows["r"].high) == (3, 5, 2, 3)
    assert (rows["quiet"].files_scanned, rows["quiet"].findings) == (1, 0)
    assert {r.repo: r.breached for r in report.fail_on(*result, "high").collect()} == {"r": True, "quiet": False}
    assert {r.breached for r in report.fail_on(*result, "critical").collect()} == {False}
    counts = [(r.severity, r.findings) for r in report.severity_counts(result[0]).collect()]
    assert counts == [("high", 3), ("medium", 2)]
    assert severity_at_least(result[0], "info").count() == 7
    with pytest.raises(ValueError, match=" | ".join(SEVERITIES).replace("|", r"\|")):
        report.fail_on(*result, "severe")


def test_text_report(result):
    rows = report.findings_report(result[0]).collect()
    assert [r.severity_rank for r in rows] == [3, 3, 3, 2, 2]
    assert rows[0].text.split("\n")[:3] == ["HIGH Use of eval() [misconfig.eval]", "  src/a.js:1", "  eval(x)"]
    lines = {r.repo: r.text for r in report.summary_lines(report.scan_summary(*result)).collect()}
    assert lines["quiet"] == "No issues found.\nScanned 1 files."
    assert lines["r"] == "5 findings  3 high · 2 medium\nScanned 3 files.\n2 finding(s) suppressed."


def test_the_pass_counts_what_it_reads(corpus_of):
    files = corpus_of({"a.js": "eval(x)", "b.md": "é", "Dockerfile": "FROM a:latest", "node_modules/c.js": "eval(y)", "d.bin": "eval(z)"})
    for options in (ScanOptions(), ScanOptions(no_ignore=True), ScanOptions(exclude_dirs=("gone",))):
        counts = Observation()
        result = scan(files, options=options, observation=counts)
        found = result.findings.count()
        assert found > 1 and counts.get["files_scanned"] == result.scanned.count()
        assert counts.get["bytes_scanned"] == sum(r.size for r in result.scanned.select("size").collect())
        assert (counts.get["dockerfiles"], counts.get["code_files"], counts.get["workflows"]) == (1, 1, 0)
