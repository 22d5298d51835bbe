"""Resolution, versions, scores and the advisory lookup."""

import json

import pytest
from pyspark.sql import functions as F

from wardlake.functions.cvss import advisory_severity, cvss_base_score
from wardlake.functions.versions import version_key
from wardlake.model import ADVISORIES_SCHEMA
from wardlake.operators import dependencies as D
from wardlake.sources.advisories import read_advisories

LOCK = {
    "packages": {
        "": {"version": "9.9.9"},
        "node_modules/a": {"version": "1.0.0"},
        "node_modules/b/node_modules/a": {"version": "1.0.0"},
        "node_modules/c/node_modules/a": {"version": "2.0.0"},
        "node_modules/@s/p": {"version": "3.0.0-rc.1"},
        "node_modules/link": {"link": True},
        "packages/w": {"version": "1.1.1"},
    }
}
MANIFEST = {
    "dependencies": {"x": "^1.2.3", "y": "~2", "z": ">= 3.4", "w": "workspace:*", "any": "*", "both": "1.0.0"},
    "devDependencies": {"both": "=2.0.0-beta.1", "or": "1 || 2", "f": "file:../f", "g": "git+https://h", "r": ">1 <2", "v": "4.5.6+b"},
}


def files_of(corpus_of, **repos):
    return corpus_of({(repo, path): text for repo, parts in repos.items() for path, text in parts.items()})


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_lock(corpus_of):
    files = files_of(
        corpus_of,
        a={"package-lock.json": json.dumps(LOCK), "x/package-lock.json": json.dumps(LOCK)},
        b={"package-lock.json": "nope"},
        c={"package-lock.json": "{}"},
    )
    assert rows(D.lock_dependencies(files), "repo", "name", "version") == [
        ("a", "@s/p", "3.0.0-rc.1"), ("a", "a", "1.0.0"), ("a", "a", "2.0.0")
    ]


def test_manifest(corpus_of):
    files = files_of(corpus_of, a={"package.json": json.dumps(MANIFEST)}, b={"package.json": "{ nope"}, c={"package.json": "[]"})
    assert rows(D.manifest_dependencies(files), "name", "version") == [
        ("both", "2.0.0-beta.1"), ("v", "4.5.6+b"), ("x", "1.2.3"), ("y", "2"), ("z", "3.4")
    ]
    assert rows(D.manifest_parse_errors(files), "repo", "path") == [("b", "package.json")]
    skipped = D.skipped_specifiers(files).collect()
    assert [(r.repo, r.skipped, r["first"]) for r in skipped] == [
        ("a", 6, "w@workspace:*, any@*, or@1 || 2, f@file:../f, g@git+https://h")
    ]


def test_lock_wins_unless_it_is_empty(corpus_of):
    manifest = json.dumps({"dependencies": {"m": "1.0.0"}})
    files = files_of(
        corpus_of,
        both={"package-lock.json": json.dumps(LOCK), "package.json": manifest},
        empty={"package-lock.json": '{"packages": {}}', "package.json": manifest},
        broken={"package-lock.json": "{", "package.json": manifest},
        none={"a.js": ""},
    )
    found = rows(D.resolved_dependencies(files), "repo", "name", "origin")
    assert [f for f in found if f[0] != "both"] == [("broken", "m", "manifest"), ("empty", "m", "manifest")]
    assert {f[2] for f in found if f[0] == "both"} == {"lock"}


SCORES = {
    "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": 9.8,
    "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N": 6.1,
    "CVSS:3.0/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:N/A:N": 5.5,
    "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N": 0.0,
    "CVSS:3.1/AV:N/AC:L/PR:L/UI:N/S:C/C:H/I:H/A:H": 9.9,
    "CVSS:3.1/AV:P/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": 9.8,
    "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H": None,
    "CVSS:3.1/AV:X/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": None,
    "CVSS:4.0/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": None,
    "AV:N/AC:L/Au:N/C:P/I:P/A:P": None,
    "": None,
}


def test_cvss(spark):
    df = spark.createDataFrame([(v,) for v in SCORES], "v string")
    assert {r.v: r.s for r in df.select("v", cvss_base_score(F.col("v")).alias("s")).collect()} == SCORES


@pytest.mark.parametrize(
    "label,entries,expected",
    [
        ("critical", [], "critical"), ("High", [], "high"), ("MODERATE", [], "medium"), ("medium", [], "medium"),
        ("low", [], "low"), (None, [], "medium"), (None, None, "medium"),
        ("odd", [("CVSS_V3", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H")], "critical"),
        (None, [("CVSS_V2", "x"), ("CVSS_V31", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N")], "low"),
        (None, [("CVSS_V3", "broken"), ("CVSS_V3", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H")], "medium"),
        (None, [("CVSS_V4", "CVSS:4.0/AV:N")], "medium"),
    ],
)
def test_advisory_severity(spark, label, entries, expected):
    df = spark.createDataFrame([(label, entries)], "l string, e array<struct<type:string,score:string>>")
    assert df.select(advisory_severity(F.col("l"), F.col("e"))).first()[0] == expected


def test_version_order(spark):
    ordered = ["0.9", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11",
               "1.0.0-rc.1", "1", "1.0.1", "1.2", "1.10.0", "2.0.0-9", "2.0.0-10", "2.0.0-99999999999999999999", "2.0.0-a", "2.0.0+b", "10"]
    df = spark.createDataFrame([(v,) for v in [*ordered[::-1], "x", "1.2.3.4"]], "v string")
    keyed = df.withColumn("k", version_key(F.col("v"))).orderBy("k").collect()
    assert [r.v for r in keyed if r.k] == ordered
    assert {r.v for r in keyed if r.k is None} == {"x", "1.2.3.4"}


def test_matches_against_brute_force(spark):
    """All (dependency, advisory) pairs tried one by one in Python."""
    versions = ["0.9.0", "1.0.0", "1.4.0", "2.0.0-beta.10", "2.0.0-rc.1", "2.0.0", "odd"]
    deps = [(f"r{i % 5}", n, v, "lock") for i, (n, v) in enumerate((n, v) for n in "abc" for v in versions)]
    deps += [(f"r{i}", "a", "1.0.0", "lock") for i in range(5, 60)]
    advisories = [
        ("A1", "npm", "a", None, "HIGH", [], ["1.0.0", "odd"], []),
        ("A2", "npm", "a", None, None, [], [], [(None, "1.4.0", None)]),
        ("A2", "npm", "a", None, None, [], ["2.0.0"], []),
        ("A3", "npm", "b", None, None, [], [], [("1.0.0", None, None)]),
        ("A4", "npm", "c", None, None, [], ["0.9.0"], [("0.1.0", "1.0.0", None), ("1.4.0", "2.0.0", None)]),
        ("A7", "npm", "c", None, None, [], [], [(None, None, "1.0.0")]),
        ("A8", "npm", "a", None, None, [], [], [("2.0.0-beta.9", "2.0.0-rc.1", None), ("2.0.0-rc.1", "2.0.0", None)]),
        ("A5", "PyPI", "a", None, None, [], ["1.0.0"], []),
        ("A6", "npm", "b", None, None, [], [], [("bad", None, None)]),
    ]
    order = {v: i for i, v in enumerate(["0.1.0", "0.9.0", "1.0.0", "1.4.0", "2.0.0-beta.9", "2.0.0-beta.10", "2.0.0-rc.1", "2.0.0"])}

    def applies(version, adv):
        if version in adv[6]:
            return True
        at = order.get(version)
        return at is not None and any(
            low != "bad" and (low is None or order[low] <= at) and (high is None or at < order[high]) and (last is None or at <= order[last])
            for low, high, last in adv[7]
        )

    expected = sorted({(d[0], d[1], d[2], a[0]) for d in deps for a in advisories if a[1] == "npm" and a[2] == d[1] and applies(d[2], a)})
    d = spark.createDataFrame(deps, "repo string, name string, version string, origin string")
    a = spark.createDataFrame(advisories, ADVISORIES_SCHEMA)
    assert rows(D.advisory_matches(d, a), "repo", "name", "version", "id") == expected
    coverage = {r.repo: (r.dependencies, r.unknown_packages) for r in D.dependency_coverage(d, a.filter("name != 'c'")).collect()}
    assert sum(n for n, _ in coverage.values()) == len(deps)
    assert sum(u for _, u in coverage.values()) == sum(x[1] == "c" for x in deps)


def test_finding_texts(spark):
    matches = spark.createDataFrame(
        [("r", "n", "1.0", "lock", "ADV-1", "s" * 200, "high"), ("r", "n", "1.0", "lock", "ADV-2", None, "low")],
        "repo string, name string, version string, origin string, id string, summary string, severity string",
    )
    first, second = D.dependency_findings(matches).orderBy("rule_id").collect()
    assert (first.rule_id, first.title, first.path, first.line) == ("dependency.ADV-1", "n@1.0: ADV-1", "package.json", None)
    assert first.excerpt == "s" * 160 and second.excerpt == "ADV-2"
    assert first.remediation == "Review https://osv.dev/vulnerability/ADV-1 and upgrade n to a patched version."


def test_read_osv_records(spark, tmp_path):
    record = {
        "id": "X-1", "summary": "s", "severity": [{"type": "CVSS_V3", "score": "v"}], "database_specific": {"severity": "HIGH"},
        "affected": [{"package": {"ecosystem": "npm", "name": "p"}, "versions": ["1.0.0"], "ranges": [
            {"type": "GIT", "events": [{"introduced": "abc"}]},
            {"type": "SEMVER", "events": [{"introduced": "2.0.0"}, {"fixed": "1.2.0"}, {"introduced": "0"}]},
            {"type": "ECOSYSTEM", "events": [{"introduced": "3.0.0-rc.1"}, {"last_affected": "3.1.0"}, {"introduced": "10.0.0"}]}]}],
    }
    (tmp_path / "x.json").write_text(json.dumps(record, indent=1))
    row = read_advisories(spark, str(tmp_path)).first()
    assert (row.id, row.ecosystem, row.name, row.db_severity, row.versions) == ("X-1", "npm", "p", "HIGH", ["1.0.0"])
    assert [tuple(r) for r in row.ranges] == [
        (None, "1.2.0", None), ("2.0.0", None, None), ("3.0.0-rc.1", None, "3.1.0"), ("10.0.0", None, None)
    ]


def test_json_as_a_browser_reads_it(spark, corpus_of):
    """Of equal keys the last counts, and an odd entry is only itself left out."""
    lock = '{"packages":{"node_modules/a":{"version":"1.0.0"},"node_modules/a":{"version":"2.0.0"},"node_modules/b":"odd","node_modules/c":null,"node_modules/d":{"version":"3.0.0"}}}'
    manifest = '{"dependencies":{"x":"1.0.0","y":"*","x":"^2.0.0"},"name":"n","name":"m"}'
    files = corpus_of({("r", "package-lock.json"): lock, ("s", "package.json"): manifest})
    assert rows(D.lock_dependencies(files), "name", "version") == [("a", "2.0.0"), ("d", "3.0.0")]
    assert rows(D.manifest_dependencies(files), "name", "version") == [("x", "2.0.0")]
    assert D.manifest_parse_errors(files).count() == 0
    assert rows(D.skipped_specifier_rows(files), "repo", "name", "specifier") == [("s", "y", "*")]


def test_withdrawn_advisories_are_left_out(spark, tmp_path):
    affected = [{"package": {"ecosystem": "npm", "name": "p"}, "versions": ["1.0.0"]}]
    records = [{"id": "X-1", "affected": affected}, {"id": "X-2", "withdrawn": "2026-01-01T00:00:00Z", "affected": affected}]
    (tmp_path / "x.json").write_text("\n".join(map(json.dumps, records)))
    assert [r.id for r in read_advisories(spark, str(tmp_path), multi_line=False).collect()] == ["X-1"]
