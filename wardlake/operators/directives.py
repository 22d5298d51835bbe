"""In-source suppression directives: ``// scanner-ignore`` with optional rule ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.text import DOT, S, js_trim
from wardlake.sources.corpus import explode_lines

# Fixed value: the directive. No word end is asked for, and only the first one on a
# line counts.
_START = rf"(?i)//{S}*scanner-ignore"
_WITH_IDS = rf"(?i)//{S}*scanner-ignore(?::{S}*({DOT}+))?"


def mentions_directive(lowered: Column) -> Column:
    """Quick test on lower-case text; a directive is sure to pass it."""
    return lowered.contains("scanner-ignore")


def has_directive(text: Column) -> Column:
    return mentions_directive(F.lower(text)) & text.rlike(_START)


def directive_ids(line: Column) -> Column:
    """Rule ids named by a line's directive: empty means all rules, null no directive."""
    named = F.regexp_extract(line, _WITH_IDS, 1)
    ids = F.filter(F.transform(F.split(named, ",", -1), js_trim), lambda i: i != "")
    return F.when(line.rlike(_START), ids)


def covers(line: Column, rule_id: Column) -> Column:
    """Whether a directive on this line suppresses the rule; never null."""
    ids = directive_ids(line)
    hit = (F.size(ids) == 0) | F.array_contains(ids, rule_id)
    mentioned = mentions_directive(F.lower(line))
    return F.when(mentioned, F.coalesce(hit, F.lit(False))).otherwise(F.lit(False))


def inline_directives(files: DataFrame) -> DataFrame:
    """Directives as rows: the line they stand on and their rule ids."""
    lines = explode_lines(files.filter(has_directive(F.col("content"))))
    return lines.select("repo", "path", "line_no", directive_ids(F.col("line")).alias("rule_ids")).filter(
        F.col("rule_ids").isNotNull()
    )
