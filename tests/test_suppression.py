"""Ignore files and directives."""

import pytest

from wardlake.operators import suppression as S
from wardlake.plans.scan import DEFAULT_RULES, ScanOptions, scan
from wardlake.operators.rules import scan_lines
from wardlake.sources.corpus import scanned_files

EVAL, HTTP = "misconfig.eval", "misconfig.insecure-http"

IGNORE = """
# comment
src/whole.js
src/rule.js   misconfig.eval   third tokens are ignored
src/legacy
src/slash/
*  misconfig.insecure-http
"""
BOTH = 'eval("http://x.y" + z)\n'
FILES = {
    ".scannerignore": IGNORE,
    "src/whole.js": BOTH,
    "src/rule.js": BOTH,
    "src/rule.js2/a.js": BOTH,
    "src/legacy/deep/a.js": BOTH,
    "src/legacy.js": BOTH,
    "src/slash/a.js": BOTH,
    "a/src/whole.js": BOTH,
    ("other", "src/whole.js"): BOTH,
}

INLINE = {
    "same.js": ("eval(a) // scanner-ignore: misconfig.eval", ["inSource"]),
    "next.js": ("// scanner-ignore: misconfig.eval\neval(a)\neval(b)", [None, "inSource"]),
    "trail.js": ("f() // scanner-ignore\neval(a)", ["inSource"]),
    "all.js": ("eval(a) //scanner-ignore", ["inSource"]),
    "list.js": ("eval(a) // SCANNER-IGNORE: x.y , misconfig.eval", ["inSource"]),
    "other.js": ("eval(a) // scanner-ignore: misconfig.cors-wildcard", [None]),
    "blank.js": ("eval(a) // scanner-ignore: , ,", ["inSource"]),
    "suffix.js": ("eval(a) // scanner-ignored", ["inSource"]),
    "first.js": ("eval(a) // scanner-ignore: a.b // scanner-ignore", [None]),
    "hash.js": ("eval(a) # scanner-ignore", [None]),
    "far.js": ("// scanner-ignore\n\neval(a)", [None]),
    "crlf.js": ("// scanner-ignore: misconfig.eval\r\neval(a)", ["inSource"]),
}


def test_external(corpus_of):
    rows = scan(corpus_of(FILES)).findings.collect()
    kinds = {(r.repo, r.path, r.rule_id): r.suppression_kind for r in rows}
    external = {k for k, v in kinds.items() if v == "external"}
    everywhere = {("r", p, HTTP) for p in FILES if isinstance(p, str) and p.endswith(".js")}
    evals = {("r", p, EVAL) for p in ("src/whole.js", "src/rule.js", "src/legacy/deep/a.js", "src/slash/a.js")}
    assert external == everywhere | evals
    assert kinds[("other", "src/whole.js", EVAL)] is None


@pytest.mark.parametrize("as_join", [False, True])
def test_inline(corpus_of, as_join):
    files = corpus_of({p: c for p, (c, _) in INLINE.items()})
    if as_join:
        raw = scan_lines(scanned_files(files), DEFAULT_RULES)
        rows = S.apply_suppressions(S.suppress_inline(raw, files), files).collect()
    else:
        rows = scan(files).findings.collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r.path, []).append(r.suppression_kind)
    assert {p: sorted(k, key=str) for p, k in kinds.items()} == {
        p: sorted(k, key=str) for p, (_, k) in INLINE.items()
    }


def test_directive_without_line_does_not_apply(corpus_of):
    files = corpus_of({"Dockerfile": "# // scanner-ignore\nFROM a:1 // scanner-ignore"})
    assert [r.suppression_kind for r in scan(files).findings.collect()] == [None]


def test_external_comes_first_and_no_ignore_keeps_all(corpus_of):
    files = corpus_of({".scannerignore": "a.js\n", "a.js": "eval(x) // scanner-ignore"})
    assert [r.suppression_kind for r in scan(files).findings.collect()] == ["external"]
    result = scan(files, options=ScanOptions(no_ignore=True)).findings
    assert [r.suppression_kind for r in result.collect()] == [None]


def test_parse(corpus_of):
    rows = S.parse_ignore_rules(corpus_of(FILES)).orderBy("place").collect()
    assert [(r.ignore_path, r.ignore_rule) for r in rows] == [
        ("src/whole.js", None), ("src/rule.js", EVAL), ("src/legacy", None), ("src/slash/", None), (None, HTTP)
    ]
    assert S.parse_ignore_rules(corpus_of({"a.js": ""})).count() == 0


def test_active_and_suppressed_are_all(corpus_of):
    findings = scan(corpus_of(FILES)).findings
    assert S.active(findings).count() + S.suppressed(findings).count() == findings.count()


def test_a_long_ignore_file(corpus_of, spark):
    """Rules of a long file meet findings by equality; its lines repeat and mostly cover nothing."""
    ignore = "\n".join([f"gone/{n}/x.js misconfig.eval" for n in range(5_000)] + ["kept/b.js", "kept/b.js", "kept/dir misconfig.eval"])
    files = corpus_of({".scannerignore": ignore, "kept/a.js": BOTH, "kept/b.js": BOTH, "kept/dir/c.js": BOTH})
    findings = scan_lines(scanned_files(files), DEFAULT_RULES)
    rows = S.suppress_external(findings, files).filter("external_hit").collect()
    assert sorted((r.path, r.rule_id) for r in rows) == [("kept/b.js", EVAL), ("kept/b.js", HTTP), ("kept/dir/c.js", EVAL)]
    assert S.suppress_external(findings, files).count() == findings.count()
