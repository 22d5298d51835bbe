"""Snapshots, restricted scans, environment files and the stream."""

from wardlake.operators import changes
from wardlake.operators.env_files import committed_env_files, untracked_env_files
from wardlake.plans.scan import diff_scan
from wardlake.streaming.incremental import ARRIVALS_SCHEMA, read_arrivals, scan_stream, store_findings


def test_changed_files(corpus_of):
    base = corpus_of({"same.js": "a", "edit.js": "a", "gone/package.json": "{}"})
    head = corpus_of({"same.js": "a", "edit.js": "b", "new.js": "c", ("q", "same.js"): "a"})
    changed = changes.changed_files(base, head)
    assert {(r.repo, r.path, r.change) for r in changed.collect()} == {
        ("r", "edit.js", "modified"), ("r", "new.js", "added"), ("r", "gone/package.json", "deleted"), ("q", "same.js", "added")
    }
    assert [r.repo for r in changes.dependency_gate(changed).collect()] == ["r"]
    assert changes.env_gate(changed).count() == 0


def test_changed_folders(spark, corpus_of, monkeypatch):
    same = {("s", f"lib/{i}.js"): str(i) for i in range(5)} | {("r", "keep/a.js"): "a", ("r", "README"): "x"}
    base = corpus_of({**same, ("r", "src/edit.js"): "a", ("r", "old/x/gone.js"): "", ("q", "top.js"): "1"})
    head = corpus_of({**same, ("r", "src/edit.js"): "b", ("r", "new/n.js"): "c", ("q", "top.js"): "1", ("q", "added"): ""})
    digests = [changes.folder_digests(side) for side in (base, head)]
    folders = changes.changed_folders(*digests)
    assert {tuple(r) for r in folders.collect()} == {("r", "src"), ("r", "old"), ("r", "new"), ("q", "")}
    whole = {tuple(r) for r in changes.changed_files(base, head).collect()}
    assert len(whole) == 4
    for limit in (10, 1):
        monkeypatch.setattr(changes, "BROADCAST_FILES", limit)
        found = changes.changed_files_within(base, head, folders)
        assert {tuple(r) for r in found.collect()} == whole
    assert changes.changed_folders(digests[0], changes.folder_digests(base.orderBy("content"))).count() == 0
    empty = base.limit(0)
    assert changes.changed_folders(changes.folder_digests(empty), changes.folder_digests(empty)).count() == 0
    assert changes.changed_folders(changes.folder_digests(empty), digests[1]).count() == 6
    # moving a text from one path to another is a change, whatever the sums
    swapped = [corpus_of({"d/a": x, "d/b": y}) for x, y in (("1", "2"), ("2", "1"))]
    assert changes.changed_folders(*map(changes.folder_digests, swapped)).count() == 1


def test_broadcasts_are_bounded_by_rows_and_bytes(spark, monkeypatch):
    names = spark.createDataFrame([("r", "a" * 10), (None, "é" * 5)], "repo string, path string")
    assert changes.fits_broadcast(names, 2) and not changes.fits_broadcast(names, 1)
    assert changes.fits_broadcast(names.limit(0), 0)
    monkeypatch.setattr(changes, "BROADCAST_BYTES", 20)
    assert not changes.fits_broadcast(names, 2)
    monkeypatch.setattr(changes, "BROADCAST_BYTES", 21)
    assert changes.fits_broadcast(names, 2)


def test_a_null_text_differs_from_none(spark):
    schema = "repo string, path string, size long, content string"
    with_null, without = spark.createDataFrame([("r", "a", 0, None)], schema), spark.createDataFrame([], schema)
    assert changes.changed_folders(changes.folder_digests(without), changes.folder_digests(with_null)).count() == 1


def test_diff_scan(spark, corpus_of):
    tracked = spark.createDataFrame([("r", ".env"), ("r", "sub/.env.prod"), ("q", ".env")], "repo string, path string")
    base = corpus_of({"a.js": "eval(a)", "b.js": "", ".env": "A=1"})
    head = corpus_of({"a.js": "eval(a)", "b.js": "eval(b)", ".env": "A=2", "test/c.js": "eval(c)"})
    found = diff_scan(base, head, tracked=tracked).findings.collect()
    assert {(r.rule_id, r.path) for r in found} == {
        ("misconfig.eval", "b.js"), ("misconfig.committed-env-file", ".env"), ("misconfig.committed-env-file", "sub/.env.prod")
    }
    unchanged_env = corpus_of({"a.js": "eval(a)", "b.js": "eval(b)", ".env": "A=1"})
    found = diff_scan(base, unchanged_env, tracked=tracked).findings.collect()
    assert {(r.rule_id, r.path) for r in found} == {("misconfig.eval", "b.js")}


def test_env_files(spark, corpus_of):
    names = [".env", "x/.env.production", ".envrc", ".env.example", ".env.SAMPLE", ".env.template", ".env.dist", "env", "node_modules/.env", ".environment"]
    tracked = spark.createDataFrame([("r", n) for n in names], "repo string, path string")
    found = {r.path for r in committed_env_files(tracked).collect()}
    assert found == {".env", "x/.env.production", "node_modules/.env", ".environment"}
    files = corpus_of({".env": "", ".env.local": "", ".env.example": ""})
    assert {r.path for r in untracked_env_files(files, tracked).collect()} == {".env.local"}


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")

    def arrive(*rows):
        data = [("r", p, len(c), c) for p, c in rows]
        df = spark.createDataFrame(data, "repo string, path string, size long, content string")
        df.selectExpr("*", "timestamp'2026-01-01 00:00:00' AS arrived_at").write.mode("append").parquet(source)

    def run():
        findings = scan_stream(read_arrivals(spark, source))
        store_findings(findings, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r.path, r.rule_id, r.line) for r in rows)

    assert ARRIVALS_SCHEMA.endswith("timestamp")
    arrive(("a.js", "eval(a)"), ("b.js", "f()"))
    assert run() == [("a.js", "misconfig.eval", 1)]
    arrive(("a.js", "eval(a)"), ("b.js", "\neval(b)"))
    assert run() == [("a.js", "misconfig.eval", 1), ("b.js", "misconfig.eval", 2)]
    # late, in two files of one batch, and covered by a directive
    late = spark.createDataFrame([("r", "c.js", 30, "eval(c) // scanner-ignore")], "repo string, path string, size long, content string")
    for hour in ("2025-01-01 00:00:00", "2025-01-01 05:00:00"):
        late.selectExpr("*", f"timestamp'{hour}' AS arrived_at").write.mode("append").parquet(source)
    assert run() == [("a.js", "misconfig.eval", 1), ("b.js", "misconfig.eval", 2), ("c.js", "misconfig.eval", 1)]
    assert {r.path: r.in_source for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a.js": False, "b.js": False, "c.js": True}


def test_stream_with_other_rules(spark, tmp_path):
    """A file that comes again gives what added rules find in it, and nothing twice."""
    from wardlake.operators.code_rules import EVAL, NEW_FUNCTION

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    text = "eval(a); eval(a)\nnew Function(b)\neval(new Function(c))"

    def run(rules, *texts):
        data = [("r", "a.js", len(t), t) for t in texts]
        df = spark.createDataFrame(data, "repo string, path string, size long, content string")
        df.selectExpr("*", "timestamp'2026-01-01 00:00:00' AS arrived_at").write.mode("append").parquet(source)
        store_findings(scan_stream(read_arrivals(spark, source), rules), out, str(tmp_path / "cp")).awaitTermination()
        return sorted((r.rule_id.split(".")[1], r.line) for r in spark.read.parquet(out).collect())

    first = run([EVAL], text)
    assert {line for _, line in first} == {1, 3}
    assert run([EVAL], text) == first
    assert run([EVAL], text, text) == first
    name = NEW_FUNCTION.rule_id.split(".")[1]
    added = sorted([*first, (name, 2), (name, 3)])
    assert run([EVAL, NEW_FUNCTION], text) == added
    assert run([NEW_FUNCTION, EVAL], text) == added
    assert run([EVAL, NEW_FUNCTION], text + "\n") == sorted([*added, *added])  # another version of the file


def test_the_stream_reads_no_stored_findings(spark, tmp_path, capsys):
    from wardlake.streaming.incremental import new_findings

    empty = spark.createDataFrame([], ARRIVALS_SCHEMA)
    empty.write.parquet(str(tmp_path / "in"))
    arrivals = read_arrivals(spark, str(tmp_path / "in"))
    new_findings(scan_stream(arrivals)).explain()
    plan = capsys.readouterr().out
    assert "StreamingDeduplicate" in plan and "Join" not in plan and plan.count("FileSource") <= 1 and "FileScan" not in plan


def test_a_restricted_scan_moves_no_content(spark, corpus_of, monkeypatch):
    from wardlake.plans import scan as S

    files = corpus_of({"a.js": "eval(a)", "b.js": "eval(b)", "c.js": "f()"})
    changed = spark.createDataFrame([("r", "b.js", "modified"), ("r", "c.js", "added")], "repo string, path string, change string")
    monkeypatch.setattr(S, "apply_suppressions", lambda findings, *rest: findings)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit in (10, 1):
            monkeypatch.setattr(S, "BROADCAST_FILES", limit)
            result = S.scan(files, changed=changed)
            assert [(r.path, r.rule_id) for r in result.findings.collect()] == [("b.js", "misconfig.eval")]
            assert {r.path for r in result.scanned.collect()} == {"b.js", "c.js"}
            for frame in (result.findings, result.scanned):
                plan = frame._jdf.queryExecution().executedPlan().toString()
                assert not any("content" in line for line in plan.split("\n") if "Exchange" in line)
                assert limit == 1 or "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
