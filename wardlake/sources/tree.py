"""Directories listed and read in tasks: every file below a root, whatever its name.

Spark's own file index leaves out names that begin with a dot or an underscore, which
would lose workflow files, environment files and ignore files. Here names are listed first,
in rounds: a task walks each of its directories for a bounded number of entries and hands
the directories it hasn't entered to the next round, which deals them out anew. So a
repository with a third of all files spreads like any other. Then the files, not the
repositories, are dealt over tasks by their number and bytes, and read in batches of
bounded size. The driver lists nothing. Excluded directories are not entered and links are
not followed. What can't be listed or read is a row too, with the reason.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator, Sequence
from functools import partial
from math import ceil

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.session import shared_folder

TREE_SCHEMA = "repo string, path string, size long, content string, error string"
#: The repository of files that lie directly at the root of a tree of repositories.
ROOT_REPO = "."
#: Bytes of content in a batch, about.
BATCH_BYTES = 16_000_000
#: Entries that a directory is walked for before what is left goes to the next round.
WALKED_ENTRIES = 5_000
#: Directories listed by a task in a round, about, and bytes and files that a task reads.
TASK_DIRECTORIES = 16
TASK_BYTES = 512_000_000
TASK_FILES = 500

_LISTING = "path string, size long, kind string, error string"
# What a listed path is: a file, or a directory that waits for the next round. Null with an error.
_FILE, _WAITING = "file", "waiting"


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path within it."""
    if "://" not in root and not root.startswith("file:"):
        return pafs.LocalFileSystem(), root
    return pafs.FileSystem.from_uri(root if "://" in root else root.replace("file:", "file://", 1))


def _listed(system: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    return sorted(system.get_file_info(pafs.FileSelector(folder)), key=lambda e: e.base_name)


def _is_link(system: pafs.FileSystem, path: str) -> bool:
    """Links are not followed, so that a walk ends; only local systems have them."""
    if not isinstance(system, pafs.LocalFileSystem):
        return False
    from pathlib import Path

    return Path(path).is_symlink()


def _reason(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:500]


def _walked(
    system: pafs.FileSystem, start: str, skipped: frozenset[str], entries: int = WALKED_ENTRIES
) -> Iterator[tuple[str, int, str | None, str | None]]:
    """Path, size, kind and error of the files below a directory, and of directories left to walk.

    Breadth first, so that what is left after ``entries`` lies side by side. The first
    directory is always listed whole.
    """
    waiting = deque([start])
    seen = 0
    while waiting:
        at = waiting.popleft()
        if seen >= entries:
            yield at, 0, _WAITING, None
            continue
        try:
            if system.get_file_info(at).type == pafs.FileType.NotFound:
                continue
            inside = [e for e in _listed(system, at) if not _is_link(system, e.path)]
        except OSError as error:
            yield at, 0, None, _reason(error)
            continue
        seen += len(inside)
        for entry in inside:
            if entry.type != pafs.FileType.Directory:
                yield entry.path, entry.size or 0, _FILE, None
            elif entry.base_name not in skipped:
                waiting.append(entry.path)


def _text(system: pafs.FileSystem, path: str) -> tuple[int, str | None, str | None]:
    """Size, text and error of a file; bytes that are no UTF-8 become replacement characters."""
    try:
        with system.open_input_stream(path) as stream:
            data = stream.read()
    except OSError as error:
        return 0, None, _reason(error)
    return len(data), data.decode("utf-8", "replace"), None


def _batch(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _list_batches(root: str, skipped: frozenset[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    system, _ = _opened(root)
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("kind", pa.string()), ("error", pa.string())])
    rows: list[tuple] = []
    for batch in batches:
        for start in batch.column("path").to_pylist():
            for row in _walked(system, start, skipped):
                rows.append(row)
                if len(rows) >= 10_000:
                    yield _batch(rows, schema)
                    rows.clear()
    if rows:
        yield _batch(rows, schema)


def _read_batches(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    system, _ = _opened(root)
    text = pa.string()
    schema = pa.schema([("path", text), ("size", pa.int64()), ("content", text), ("error", text)])
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for path, error in zip(batch.column("path").to_pylist(), batch.column("error").to_pylist(), strict=True):
            rows.append((path, *((0, None, error) if error else _text(system, path))))
            held += rows[-1][1]
            if held >= BATCH_BYTES or len(rows) >= 10_000:
                yield _batch(rows, schema)
                rows.clear()
                held = 0
    if rows:
        yield _batch(rows, schema)


def list_tree(spark: SparkSession, root: str, base: str, skipped: Sequence[str]) -> DataFrame:
    """Path, size, kind and error of everything below ``base``, kept in the shared folder round by round."""
    target = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}"
    most = 4 * spark.sparkContext.defaultParallelism
    run = partial(_list_batches, root, frozenset(skipped))
    folders, number, rounds = spark.createDataFrame([(base,)], "path string"), 1, 0
    while number:
        tasks = max(1, min(ceil(number / TASK_DIRECTORIES), most))
        folders.repartition(tasks, "path").mapInArrow(run, _LISTING).write.parquet(f"{target}/round={rounds}")
        found = spark.read.schema(_LISTING).parquet(f"{target}/round={rounds}")
        folders = found.filter(F.col("kind") == _WAITING).select("path")
        number, rounds = folders.count(), rounds + 1
    return spark.read.schema(f"{_LISTING}, round int").parquet(target).drop("round")


def _placed(base: str, repo: str | None) -> tuple[Column, Column]:
    """Repository and path of a listed path."""
    inner = F.substr("path", F.lit(len(base) + (base != "/") + 1))
    if repo is not None:
        return F.lit(repo), inner
    nested = F.instr(inner, "/") > 0
    first = F.substring_index(inner, "/", 1)
    return F.when(nested, first).otherwise(ROOT_REPO), F.when(nested, F.substr(inner, F.length(first) + 2)).otherwise(inner)


def walk_tree(spark: SparkSession, root: str, repo: str | None, skipped: Sequence[str]) -> DataFrame:
    """Rows of TREE_SCHEMA; without ``repo`` every first-level directory is a repository.

    Names are listed when this is called; files are read when the rows are.
    """
    system, base = _opened(root)
    base = base.rstrip("/") or "/"
    kind = system.get_file_info(base).type
    if kind == pafs.FileType.NotFound:
        raise FileNotFoundError(f"scan path does not exist: {root}")
    if kind != pafs.FileType.Directory:
        raise NotADirectoryError(f"scan path is not a directory: {root}")
    listing = list_tree(spark, root, base, skipped).filter(f"kind IS NULL OR kind = '{_FILE}'")
    number, size = listing.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    most = 4 * spark.sparkContext.defaultParallelism
    tasks = max(1, ceil(size / TASK_BYTES), min(ceil(number / TASK_FILES), most))
    dealt = listing.select("path", "error").repartition(tasks, "path")
    read = dealt.mapInArrow(partial(_read_batches, root), "path string, size long, content string, error string")
    named, inner = _placed(base, repo)
    return read.select(named.alias("repo"), inner.alias("path"), "size", "content", "error")
