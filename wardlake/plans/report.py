"""Reports over findings: summaries, gates, fingerprints, SARIF, JSON and text.

The reports read their findings more than once. Hand them a stored table, such as the
result of ``wardlake.session.written``, not the scan itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake import __version__
from wardlake.functions.text import S, js_trim
from wardlake.model import SEVERITIES, check_severity, order_key, order_struct, severity_rank
from wardlake.operators.suppression import active
from wardlake.session import salted_join

TOOL_NAME = "wardlake"

# The SARIF version and its schema.
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = (
    "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
)

# SARIF levels, and the numbers code hosts sort alerts by.
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SECURITY_SEVERITY = {"critical": "9.5", "high": "8.0", "medium": "5.5", "low": "3.0", "info": "1.0"}
FINGERPRINT_KEY = "snippetSha256/v1"


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    value = F.lit(default)
    for name, mapped in table.items():
        value = F.when(key == name, mapped).otherwise(value)
    return value


def sarif_level(severity: Column) -> Column:
    return _lookup(SARIF_LEVELS, severity, "note")


def is_suppressed() -> Column:
    return F.col("suppression_kind").isNotNull()


def severity_counts(findings: DataFrame) -> DataFrame:
    """Active findings per repository and severity, strongest first, no zero rows."""
    return (
        active(findings)
        .groupBy("repo", "severity")
        .agg(F.count("*").alias("findings"))
        .withColumn("severity_rank", severity_rank(F.col("severity")))
        .orderBy("repo", F.desc("severity_rank"))
    )


def findings_rollup(findings: DataFrame) -> DataFrame:
    """Active and suppressed findings by repository, category and severity, with all subtotals.

    ``level`` is the grouping id: 0 for a full group, 1 without severity, 3 for a repository, 7 for the
    total; a column that a row sums over is null there. One aggregation for all levels: tasks add up
    their rows for each before anything is shuffled, so a hot repository is a few rows per task.
    """
    return (
        findings.rollup("repo", "category", "severity")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.count_if(~is_suppressed()).alias("findings"),
            F.count_if(is_suppressed()).alias("suppressed"),
        )
        .select("repo", "category", "severity", "level", "findings", "suppressed")
    )


def scan_summary(findings: DataFrame, scanned: DataFrame) -> DataFrame:
    """Files scanned, active and suppressed findings per repository, and active by severity."""
    zero = F.lit(0).cast("bigint")
    files = scanned.groupBy("repo").agg(F.count("*").alias("files_scanned"))
    found = findings.groupBy("repo").agg(
        F.count_if(~is_suppressed()).alias("findings"),
        F.count_if(is_suppressed()).alias("suppressed"),
        *[F.count_if(~is_suppressed() & (F.col("severity") == s)).alias(s) for s in reversed(SEVERITIES)],
    )
    counts = ["findings", "suppressed", *reversed(SEVERITIES)]
    left = files.select("repo", "files_scanned", *[zero.alias(c) for c in counts])
    right = found.select("repo", zero.alias("files_scanned"), *counts)
    totals = left.unionByName(right).groupBy("repo")
    return totals.agg(*[F.sum(c).alias(c) for c in ["files_scanned", *counts]])


def fail_on(findings: DataFrame, scanned: DataFrame, threshold: str) -> DataFrame:
    """Per repository: whether an active finding reaches the threshold."""
    rank = SEVERITIES.index(check_severity(threshold))
    reached = findings.groupBy("repo").agg(
        F.bool_or(~is_suppressed() & (severity_rank(F.col("severity")) >= rank)).alias("breached")
    )
    quiet = scanned.select("repo").distinct().select("repo", F.lit(False).alias("breached"))
    return reached.unionByName(quiet).groupBy("repo").agg(F.bool_or("breached").alias("breached"))


def fingerprint_hash(rule_id: Column, path: Column, text: Column) -> Column:
    """Hash that survives moves within a file: rule, path and the excerpt's words."""
    words = F.regexp_replace(js_trim(F.coalesce(text, F.lit(""))), f"{S}+", " ")
    return F.substring(F.sha2(F.concat_ws("\0", rule_id, path, words), 256), 1, 16)


def with_fingerprints(findings: DataFrame) -> DataFrame:
    """Findings with a ``fingerprint`` that is unique in their repository.

    Equal hashes get ``:0``, ``:1``… in report order. The hash covers the path, so a
    window's group is never more than the equal findings of one file.
    """
    hashed = findings.withColumn(
        "hash", fingerprint_hash(F.col("rule_id"), F.col("path"), F.col("excerpt"))
    )
    same = Window.partitionBy("repo", "hash")
    place = F.row_number().over(same.orderBy(*order_key(is_suppressed().asc()), "title")) - 1
    repeats = F.count("*").over(same) > 1
    numbered = F.concat("hash", F.lit(":"), place.cast("string"))
    return hashed.withColumn("fingerprint", F.when(repeats, numbered).otherwise(F.col("hash"))).drop("hash")


def first_findings(findings: DataFrame) -> DataFrame:
    """The first finding of every rule in a repository, active ones first.

    An aggregate and not a window: tasks reduce their rows before anything is shuffled.
    """
    place = F.struct(is_suppressed().alias("suppressed"), order_struct().alias("place"), F.col("title"))
    what = F.struct("category", "severity", "title", "remediation")
    return (
        findings.groupBy("repo", "rule_id")
        .agg(F.min_by(what, place).alias("first"), F.min(place).alias("place"))
        .select("repo", "rule_id", "first.*", "place")
    )


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One row per rule of a repository with what SARIF says about it."""
    return first_findings(findings).select(
        "repo",
        "rule_id",
        F.col("title").alias("short_description"),
        F.col("remediation").alias("full_description"),
        sarif_level(F.col("severity")).alias("level"),
        "category",
        _lookup(SECURITY_SEVERITY, F.col("severity"), "1.0").alias("security_severity"),
        "place",
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    """One row per finding with its SARIF fields; a null kind means not suppressed."""
    has_text = F.coalesce(F.col("excerpt"), F.lit("")) != ""
    message = F.when(has_text, F.concat("title", F.lit(": "), "excerpt")).otherwise(F.col("title"))
    return with_fingerprints(findings).select(
        "repo",
        "rule_id",
        sarif_level(F.col("severity")).alias("level"),
        message.alias("message"),
        F.translate("path", "\\", "/").alias("uri"),
        F.col("line").alias("start_line"),
        "fingerprint",
        "suppression_kind",
        F.struct(is_suppressed().alias("suppressed"), order_struct().alias("place"), F.col("title")).alias(
            "place"
        ),
    )


# A document is kept as fragments: rows of text that, in order, spell one JSON document
# per repository. Its size is then bounded by nothing, and no task ever holds it.
#   section 0  opening up to the first list     section 1  entries of the first list
#   section 2  from there to the second list    section 3  entries of the second list
#   section 4  closing


def _entries(rows: DataFrame, section: int, document: Column) -> DataFrame:
    """List entries as fragments, a comma before each but the first of its list."""
    firsts = rows.groupBy("repo").agg(F.min(F.struct("place", "tie")).alias("first"))
    joined = salted_join(rows, firsts, ["repo"], "left", [F.col("tie")])
    comma = F.when(F.struct("place", "tie") == F.col("first"), "").otherwise(",")
    return joined.select(
        "repo",
        F.lit(section).alias("section"),
        "place",
        "tie",
        F.concat(comma, F.to_json(document)).alias("text"),
    )


def sarif_document(findings: DataFrame, scanned: DataFrame) -> DataFrame:
    """SARIF documents of all repositories, as fragments."""
    level = F.struct(F.col("level").alias("level"))
    rule = F.struct(
        F.col("rule_id").alias("id"),
        F.col("rule_id").alias("name"),
        F.struct(F.col("short_description").alias("text")).alias("shortDescription"),
        F.struct(F.col("full_description").alias("text")).alias("fullDescription"),
        F.struct(F.col("full_description").alias("text")).alias("help"),
        level.alias("defaultConfiguration"),
        F.struct(
            F.col("category"),
            F.col("security_severity").alias("security-severity"),
            F.array(F.lit("security"), F.col("category")).alias("tags"),
        ).alias("properties"),
    )
    region = F.when(F.col("start_line").isNotNull(), F.struct(F.col("start_line").alias("startLine")))
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        F.col("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(
            F.struct(
                F.struct(F.struct(F.col("uri")).alias("artifactLocation"), region.alias("region")).alias(
                    "physicalLocation"
                )
            )
        ).alias("locations"),
        F.struct(F.col("fingerprint").alias(FINGERPRINT_KEY)).alias("partialFingerprints"),
        F.when(
            F.col("suppression_kind").isNotNull(),
            F.array(F.struct(F.col("suppression_kind").alias("kind"), F.lit("accepted").alias("status"))),
        ).alias("suppressions"),
    )
    rules = sarif_rules(findings).withColumn("tie", F.col("rule_id"))
    results = sarif_results(findings).withColumn("tie", F.col("fingerprint"))
    opening = (
        f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":'
        f'{{"name":"{TOOL_NAME}","version":"{__version__}","rules":['
    )
    fixed = {0: F.lit(opening), 2: F.lit(']}},"results":['), 4: F.lit("]}]}")}
    return _fragments(
        _repositories(findings, scanned), fixed, _entries(rules, 1, rule), _entries(results, 3, result)
    )


def json_report(
    findings: DataFrame, scanned: DataFrame, started_at: str | None = None, finished_at: str | None = None
) -> DataFrame:
    """The scan result of every repository as a JSON document, as fragments."""
    finding = F.struct(
        F.col("rule_id").alias("ruleId"),
        "category",
        "severity",
        "title",
        F.col("path").alias("file"),
        "line",
        "excerpt",
        "remediation",
        F.col("suppression_kind").alias("suppressionKind"),
    )
    place = F.struct(is_suppressed().alias("suppressed"), order_struct().alias("place"), F.col("title"))
    placed = with_fingerprints(findings).withColumns({"place": place, "tie": F.col("fingerprint")})
    repositories = scan_summary(findings, scanned)
    head = F.struct(
        F.col("repo").alias("root"),
        F.lit(started_at).cast("string").alias("startedAt"),
        F.lit(finished_at).cast("string").alias("finishedAt"),
        F.col("files_scanned").alias("filesScanned"),
    )
    fixed = {
        0: F.concat(F.rtrim(F.to_json(head), F.lit("}")), F.lit(',"findings":[')),
        2: F.lit('],"suppressedFindings":['),
        4: F.concat(F.lit('],"suppressedCount":'), F.col("suppressed").cast("string"), F.lit("}")),
    }
    return _fragments(
        repositories,
        fixed,
        _entries(placed.filter(~is_suppressed()), 1, finding),
        _entries(placed.filter(is_suppressed()), 3, finding),
    )


def _repositories(findings: DataFrame, scanned: DataFrame) -> DataFrame:
    return scanned.select("repo").union(findings.select("repo")).distinct()


def _fragments(repositories: DataFrame, fixed: dict[int, Column], *lists: DataFrame) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(n).alias("section"), text.alias("text")) for n, text in fixed.items()])
    frame = repositories.select("repo", F.explode(parts).alias("part"))
    place = lists[0].schema["place"].dataType
    rows = frame.select(
        "repo",
        F.col("part.section").alias("section"),
        F.lit(None).cast(place).alias("place"),
        F.lit("").alias("tie"),
        F.col("part.text").alias("text"),
    )
    for entries in lists:
        rows = rows.unionByName(entries)
    return rows


def ordered(fragments: DataFrame) -> DataFrame:
    """Fragments in document order; a range sort splits even one repository's rows."""
    return fragments.orderBy("repo", "section", "place", "tie")


def write_documents(fragments: DataFrame, target: str) -> None:
    """Write every repository's document to ``target/repo=<name>/``.

    A document is the concatenation of its folder's files in name order.
    """
    ordered(fragments).select("repo", "text").write.partitionBy("repo").text(target)


def findings_report(findings: DataFrame) -> DataFrame:
    """Active findings as text blocks, strongest first."""
    rank = severity_rank(F.col("severity"))
    location = F.concat("path", F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")))
    excerpt = F.when(F.coalesce("excerpt", F.lit("")) != "", F.concat(F.lit("  "), "excerpt"))
    text = F.concat_ws(
        "\n",
        F.concat(F.upper("severity"), F.lit(" "), "title", F.lit(" ["), "rule_id", F.lit("]")),
        F.concat(F.lit("  "), location),
        excerpt,
        F.concat(F.lit("  → "), "remediation"),
    )
    return (
        active(findings)
        .withColumns({"severity_rank": rank, "text": text})
        .orderBy("repo", F.desc("severity_rank"), *order_key(), "title")
        .select("repo", "rule_id", "path", "line", "severity_rank", "text")
    )


def summary_lines(summary: DataFrame) -> DataFrame:
    """The closing line of the text report for every repository."""
    counts = F.concat_ws(
        " · ",
        *[
            F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}")))
            for s in reversed(SEVERITIES)
        ],
    )
    found = F.when(F.col("findings") == 0, "No issues found.").otherwise(
        F.concat(F.col("findings").cast("string"), F.lit(" findings  "), counts)
    )
    hidden = F.when(
        F.col("suppressed") > 0, F.concat(F.col("suppressed").cast("string"), F.lit(" finding(s) suppressed."))
    )
    read = F.concat(F.lit("Scanned "), F.col("files_scanned").cast("string"), F.lit(" files."))
    return summary.select("repo", F.concat_ws("\n", found, read, hidden).alias("text"))
