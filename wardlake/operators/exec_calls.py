"""Which names in a file call the shell: bindings of ``child_process``, and call sites.

Bindings and calls of one file sit in one row, so the lookup needs no join: a file's
bound names travel with its lines as two short arrays, and only for files that mention
the module at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.code import MARK
from wardlake.functions.text import bind, construct_lines
from wardlake.sources.corpus import route

MODULE = "child_process"

_IMPORT_NAMES = rf"import\s*(?:[\w$]+\s*,\s*)?\{{([^}}]*)\}}\s*from\s*['\"]{MODULE}['\"]"
_IMPORT_WHOLE = rf"import\s+(?:\*\s+as\s+)?([\w$]+)\s*(?:,\s*\{{[^}}]*\}}\s*)?from\s*['\"]{MODULE}['\"]"
_REQUIRE = rf"require\s*\(\s*['\"]{MODULE}['\"]\s*\)"
_REQUIRE_NAMES = rf"(?:const|let|var)\s*\{{([^{{}}]*\}}\s*=\s*{_REQUIRE}\s*\.?)"
_REQUIRE_WHOLE = rf"(?:const|let|var)\s+([\w$]+\s*=\s*{_REQUIRE}(?:\s*\.\s*[\w$]+)?\s*[.(\[]?)"

# A call of exec or execSync in masked code, and one whose first argument is fixed or missing.
_CALL = r"(?=[^\w$.][\w$])(?<!\.\s{0,20})([^\w$.])((?:[\w$]+\s*\??\.\s*)?(?:execSync|exec)\s*(?:\?\.\s*)?\()"
_HEAD = r"^(?:([\w$]+)\s*\??\.\s*)?(execSync|exec)\s*(?:\?\.\s*)?\("
_FIXED_CALL = _HEAD + MARK + r"\s*(?:\)|(?:\"[^\"]*\"|`[^`$]*`|[0-9][\w.]*|true|false|null)\s*[,)])"


def _all(content: Column, pattern: str) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(1))


def _named(items: Column) -> Column:
    return F.filter(items, lambda name: name != "")


def direct_bindings(content: Column) -> Column:
    """Local names bound to a member of the module."""
    imported = F.transform(
        F.flatten(F.transform(_all(content, _IMPORT_NAMES), lambda names: F.split(names, ",", -1))),
        lambda item: F.regexp_extract(item, r"([\w$]+)\s*\z", 1),
    )
    patterns = F.filter(_all(content, _REQUIRE_NAMES), lambda text: ~text.endswith("."))
    destructured = F.transform(
        F.flatten(
            F.transform(patterns, lambda text: F.split(F.substring_index(text, "}", 1), ",", -1)),
        ),
        lambda item: F.regexp_extract(item, r"^\s*(?:[^:]*:\s*)?([\w$]+)\s*\z", 1),
    )
    members = F.transform(
        _all(content, _REQUIRE_WHOLE),
        lambda text: F.regexp_extract(text, r"^([\w$]+)(?s:.)*\.\s*(?:execSync|exec)\s*\z", 1),
    )
    return F.array_distinct(_named(F.concat(imported, destructured, members)))


def namespace_bindings(content: Column) -> Column:
    """Local names bound to the module itself."""
    required = F.transform(
        _all(content, _REQUIRE_WHOLE),
        lambda text: F.regexp_extract(text, r"^([\w$]+)(?s:.)*\)\s*\z", 1),
    )
    return F.array_distinct(_named(F.concat(_all(content, _IMPORT_WHOLE), required)))


def dynamic_call_lines(code: Column, direct: Column, namespaces: Column) -> Column:
    """Lines of the calls in masked code whose name is bound and whose first argument is not fixed text."""

    def flagged(text: Column) -> Column:
        owner, function = F.regexp_extract(text, _HEAD, 1), F.regexp_extract(text, _HEAD, 2)
        bound = F.when(owner != "", F.array_contains(namespaces, owner)).otherwise(
            F.array_contains(direct, function)
        )
        return bound & ~text.rlike(_FIXED_CALL)

    return construct_lines(code, _CALL, flagged)


def exec_lines(code: Column, content: Column) -> Column:
    return bind(
        direct_bindings(content),
        lambda direct: bind(namespace_bindings(content), lambda spaces: dynamic_call_lines(code, direct, spaces)),
    )


def exec_bindings(files: DataFrame) -> DataFrame:
    """Bindings as rows: ``direct`` names and ``namespace`` names per file."""
    content = F.col("content")
    code = route(files).filter(F.col("is_code") & content.contains(MODULE))
    kinds = F.map_from_arrays(
        F.array(F.lit("direct"), F.lit("namespace")),
        F.array(direct_bindings(content), namespace_bindings(content)),
    )
    return code.select("repo", "path", F.explode(kinds).alias("kind", "names")).select(
        "repo", "path", "kind", F.explode("names").alias("name")
    )
