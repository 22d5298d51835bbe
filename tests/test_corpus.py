"""Sources and file filters."""

import pytest
from pyspark.sql import functions as F

from wardlake.plans.scan import ScanOptions, scan
from wardlake.sources import corpus as C


def paths(df):
    return {r.path for r in df.select("path").collect()}


def test_read_tree(spark, tmp_path):
    root = tmp_path / "root"
    for name, data in {"one/src/a.js": b"x", "one/b c%.js": b"y", "two/deep/er/c.ts": b"\xff", "top.js": b"z"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    rows = {(r.repo, r.path): (r["size"], r.content) for r in C.read_tree(spark, str(root)).collect()}
    assert rows == {
        ("one", "src/a.js"): (1, "x"), ("one", "b c%.js"): (1, "y"), ("two", "deep/er/c.ts"): (1, "�"), (".", "top.js"): (1, "z")
    }
    single = C.read_tree(spark, str(root), repo="all")
    assert paths(single) == {"one/src/a.js", "one/b c%.js", "two/deep/er/c.ts", "top.js"}


def test_read_tree_keeps_every_name_and_scans_it(spark, tmp_path):
    texts = {
        ".env": 'API_KEY="abcd1234efgh5678ijkl"', ".github/workflows/a.yml": "on: pull_request_target\n  - uses: a/b@main",
        ".scannerignore": "src/_d.js\n", "_helper/b.js": "eval(b)", "__tests__/c.js": "eval(c)", "src/_d.js": "eval(d)",
        "src/e.js": "eval(e)", "node_modules/m/f.js": "eval(f)",
    }
    for name, text in texts.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(text)
    (tmp_path / "r/loop").symlink_to(tmp_path / "r")
    files = C.read_tree(spark, str(tmp_path))
    assert paths(files) == set(texts) - {"node_modules/m/f.js"}
    assert paths(C.read_tree(spark, f"file://{tmp_path}", skip_dirs=())) == set(texts)
    found = scan(files, options=ScanOptions(include_test_dirs=True)).findings.collect()
    active = {(r.path, r.rule_id.split(".")[0]) for r in found if r.suppression_kind is None}
    assert {p for p, _ in active} == {".env", ".github/workflows/a.yml", "_helper/b.js", "__tests__/c.js", "src/e.js"}
    assert {r.path for r in found if r.suppression_kind} == {"src/_d.js"}
    assert C.unreadable(spark, str(tmp_path)).count() == 0


def test_unreadable_files_are_listed(spark, tmp_path, monkeypatch):
    from wardlake.sources import tree

    class Broken:
        def get_file_info(self, path):
            raise PermissionError(path)

    assert list(tree._walked(Broken(), "x", frozenset())) == [("x", 0, None, "PermissionError: x")]


def test_a_large_repository_is_listed_in_rounds_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    from wardlake.sources import tree

    names = {f"big/d{i}/e{j}/f{k}.js" for i in range(5) for j in range(4) for k in range(3)} | {"small/a.js", "top.js", "big/d0/x.js"}
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "big/empty").mkdir()
    monkeypatch.setattr(tree._walked, "__defaults__", (2,))  # two entries for each directory of a round
    monkeypatch.setattr(tree, "TASK_DIRECTORIES", 1)
    monkeypatch.setattr(tree, "TASK_FILES", 4)
    files = C.read_tree(spark, str(tmp_path))
    rows = files.collect()
    assert sorted(r.path if r.repo == "." else f"{r.repo}/{r.path}" for r in rows) == sorted(names)
    assert all(r.content == (r.path if r.repo == "." else f"{r.repo}/{r.path}") and r["size"] == len(r.content) for r in rows)
    tasks = files.filter("repo = 'big'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 8 and max(r["count"] for r in tasks) < len(names) / 3
    assert C.unreadable(spark, str(tmp_path)).count() == 0


def test_empty_trees(spark, tmp_path):
    assert C.read_tree(spark, str(tmp_path)).count() == 0
    (tmp_path / "r/node_modules").mkdir(parents=True)
    (tmp_path / "r/node_modules/a.js").write_text("x")
    assert C.read_tree(spark, str(tmp_path)).count() == 0


def test_unreadable_files_are_rows(tmp_path):
    import pyarrow.fs as pafs

    from wardlake.sources import tree

    size, text, error = tree._text(pafs.LocalFileSystem(), str(tmp_path / "gone"))
    assert (size, text) == (0, None) and error.startswith("FileNotFoundError")


def test_read_tree_rejects_bad_roots(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        C.read_tree(spark, str(tmp_path / "absent"))
    (tmp_path / "file.js").write_text("x")
    with pytest.raises(NotADirectoryError):
        C.read_tree(spark, str(tmp_path / "file.js"))


def test_directory_filters(corpus_of):
    files = corpus_of(
        {p: "" for p in ["a.js", "test/a.js", "x/node_modules/m.js", "tests", "Test/a.js", "lib/a.js", "e2e/x/y.js"]}
    )
    kept = C.prune_directories(files, C.skipped_directories())
    assert paths(kept) == {"a.js", "tests", "Test/a.js", "lib/a.js"}
    kept = C.prune_directories(files, C.skipped_directories(include_test_dirs=True, exclude_dirs=[" lib"]))
    assert paths(kept) == {"a.js", "test/a.js", "tests", "Test/a.js", "e2e/x/y.js"}


def test_eligibility_and_routing(corpus_of):
    names = ["a.js", "A.JS", "a.py", ".env", ".env.local", ".envrc", "prod.env", "Dockerfile", "DOCKERFILE.x",
             "my.dockerfile", "Dockerfile.js", "x.tar.yml", ".js", "a.", "README", ".github/workflows/w.YML"]
    files = C.route(C.scannable(corpus_of({n: "" for n in names})))
    kinds = {r.path: (r.is_code, r.is_dockerfile, r.is_workflow) for r in files.collect()}
    code, docker, workflow, plain = (True, False, False), (False, True, False), (False, False, True), (False,) * 3
    assert kinds == {
        "a.js": code, "A.JS": plain, ".env": plain, ".env.local": plain, ".envrc": plain, "prod.env": plain,
        "Dockerfile": docker, "DOCKERFILE.x": docker, "my.dockerfile": docker, "Dockerfile.js": docker,
        "x.tar.yml": plain, ".github/workflows/w.YML": workflow,
    }


def test_size_limit(corpus_of):
    assert paths(C.within_size(corpus_of({"a": "é" * 2, "b": "abcde"}), 4)) == {"a"}


def test_lines(corpus_of):
    files = corpus_of({"a": "x\r\ny\n\nz\r\n", "b": ""})
    rows = C.explode_lines(files).orderBy("path", "line_no").collect()
    assert [(r.path, r.line_no, r.line) for r in rows] == [
        ("a", 1, "x"), ("a", 2, "y"), ("a", 3, ""), ("a", 4, "z"), ("a", 5, ""), ("b", 1, "")
    ]


def test_stored_corpus_keeps_roles_apart(spark, corpus_of, tmp_path):
    target = str(tmp_path / "corpus")
    C.write_corpus(corpus_of({"package.json": "{}", "a.js": "", "a.png": "", "x/package.json": "{}"}), target)
    stored = C.read_corpus(spark, target)
    roles = {r.path: r.role for r in stored.collect()}
    assert roles == {"package.json": "control", "a.js": "source", "a.png": "other", "x/package.json": "source"}
    plan = C.control_files(stored, "package.json")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(role" in plan and "control" in plan
    assert paths(C.scanned_files(stored)) == {"package.json", "a.js", "x/package.json"}


def test_mask(spark):
    from wardlake.functions.text import mask_code

    cases = {
        "f('a\\'b', \"c\") // d": 'f("", "") ',
        "x = `a$b` + `c${d}`": 'x = "" + `c${d}`',
        "a /* b */ c": 'a "" c',
        'u = "http://x" + y': 'u = "" + y',
    }
    rows = spark.createDataFrame([(k,) for k in cases], "line string")
    masked = {r.line: r.m for r in rows.select("line", mask_code(F.col("line")).alias("m")).collect()}
    assert masked == {k: v if not k.endswith("// d") else v + '""' for k, v in cases.items()}
