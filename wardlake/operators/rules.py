"""Rules, and the one-pass detector that runs them over file rows.

A rule says which lines it looks at and yields the excerpts of its hits as an array
column, so one rule can hit a line several times. The detector evaluates all rules of
all families in a single narrow pass: the corpus is read once and lines are never
shuffled. Cheap literal triggers keep ordinary lines away from the regex engine.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.text import bind, excerpt, is_comment_line, redact, split_lines
from wardlake.model import check_severity
from wardlake.operators.directives import covers, has_directive
from wardlake.sources.corpus import route

# Which files a rule looks at, and the routing column that says so.
SCOPES = {
    "any": None,
    "code": "is_code",
    "docker": "is_dockerfile",
    "workflow": "is_workflow",
}


@dataclass(frozen=True)
class Context:
    """What a rule may look at: a line, whether it is a comment line, and facts about its file."""

    line: Column
    comment: Column
    line_no: Column
    fact: Callable[[str], Column]


@dataclass(frozen=True)
class Fact:
    """A value computed once per file of a scope, before its lines are exploded."""

    name: str
    scope: str
    value: Callable[[Column, Column], Column]  # (content, lines) -> value
    needs: str | None = None  # literal without which the fact is null
    of: Fact | None = None  # a fact that this one is worked out from: (its value, content) -> value
    where: Callable[[Column], Column] | None = None  # condition on the content without which the fact is null


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    severity: str
    title: str
    remediation: str
    hits: Callable[[Context], Column]  # array<string> of excerpts
    scope: str = "any"
    triggers: tuple[str, ...] = ()  # one must occur; () means any line
    any_case_triggers: tuple[str, ...] = ()  # the same, lower case, ignoring case
    trigger_pattern: str | None = None
    needs: str | None = None  # literal without which a whole file is left out
    skip_comments: bool = False
    has_line: bool = True
    check_order: int = 99
    facts: tuple[Fact, ...] = field(default=())
    lines: Fact | None = None  # where this fact is known, only the lines that it lists are looked at

    def __post_init__(self) -> None:
        check_severity(self.severity)
        if self.scope not in SCOPES:
            raise ValueError(f"unknown scope {self.scope!r}; expected one of: {' | '.join(SCOPES)}")


def once(condition: Column, text: Column) -> Column:
    """Hits of a rule that reports a line at most once."""
    return F.when(condition, F.array(text))


def repeated(text: Column, count: Column) -> Column:
    return F.when(count > 0, F.array_repeat(text, count))


def pattern_rule(
    rule_id: str,
    category: str,
    severity: str,
    title: str,
    remediation: str,
    pattern: str,
    group: int = 0,
    redacted: bool = True,
    per_line: bool = False,
    **options,
) -> Rule:
    """A rule from one Java regular expression.

    It reports every occurrence with the (redacted) text of ``group``, or with
    ``per_line`` each matching line once with the line as its excerpt.
    """

    def occurrences(context: Context) -> Column:
        values = F.regexp_extract_all(context.line, F.lit(pattern), F.lit(group))
        return F.transform(values, redact) if redacted else values

    def lines(context: Context) -> Column:
        return once(context.line.rlike(pattern), excerpt(context.line))

    hits = lines if per_line else occurrences
    return Rule(rule_id, category, severity, title, remediation, hits, **options)


def rules_table(spark, rules: Sequence[Rule]) -> DataFrame:
    """The catalogue as a small DataFrame, for metadata joins."""
    rows = [(r.rule_id, r.category, r.severity, r.title, r.remediation, r.scope) for r in rules]
    schema = (
        "rule_id string, category string, severity string, title string, remediation string, scope string"
    )
    return spark.createDataFrame(rows, schema)


def _in_scope(scope: str) -> Column:
    flag = SCOPES[scope]
    return F.col(flag) if flag else F.lit(True)


def _any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


@dataclass(frozen=True)
class _Needle:
    """A literal whose presence in a file is known before the file is split."""

    scope: str
    text: str | None  # None: every file of the scope
    any_case: bool = False


def _tests(rule: Rule) -> list[tuple[_Needle, str | None]]:
    """What has to be in the file, and with it on the line, for a rule to look at it."""
    literals = [(t, False) for t in rule.triggers] + [(t, True) for t in rule.any_case_triggers]
    if rule.trigger_pattern or not rule.has_line or not literals:
        return [(_Needle(rule.scope, rule.needs), None)]
    return [
        (_Needle(rule.scope, rule.needs) if rule.needs else _Needle(rule.scope, t, any_case), t)
        for t, any_case in literals
    ]


def _needles(rules: Sequence[Rule]) -> list[_Needle]:
    return list(dict.fromkeys(needle for rule in rules for needle, _ in _tests(rule)))


def _presence(needles: Sequence[_Needle]) -> Column:
    """Array of booleans, one per needle. The text is put in lower case once for all."""

    def tests(lowered: Column) -> Column:
        found = []
        for needle in needles:
            test = _in_scope(needle.scope)
            if needle.text is not None:
                text = lowered if needle.any_case else F.col("content")
                test = test & text.contains(needle.text)
            found.append(test)
        return F.array(*found)

    if any(needle.any_case for needle in needles):
        return bind(F.lower("content"), tests)
    return tests(F.col("content"))


def _triggered(rule: Rule, needles: Sequence[_Needle]) -> Column:
    """Whether a line is worth a rule's look: only literals its file has are looked for."""
    alternatives = []
    for needle, text in _tests(rule):
        test = F.get("present", F.lit(needles.index(needle)))
        if not rule.has_line:
            test = test & (F.col("line_no") == 1)
        elif rule.trigger_pattern:
            test = test & F.col("line").rlike(rule.trigger_pattern)
        elif text is not None:
            line = F.col("lowered") if text in rule.any_case_triggers else F.col("line")
            literal = line.contains(text)
            if rule.lines:
                listed = F.col(f"fact_{rule.lines.name}")
                literal = F.when(listed.isNotNull(), F.array_contains(listed, F.col("line_no"))).otherwise(literal)
            test = test & literal
        alternatives.append(test)
    return _any_of(alternatives)


def _fact_column(fact: Fact) -> Column:
    content = F.col("content")
    wanted = _in_scope(fact.scope)
    if fact.needs:
        wanted = wanted & content.contains(fact.needs)
    if fact.where:
        wanted = wanted & fact.where(content)
    if fact.of:
        base = F.col(f"fact_{fact.of.name}")
        return F.when(wanted & base.isNotNull(), fact.value(base, content))
    return F.when(wanted, fact.value(content, split_lines(content)))


@dataclass(frozen=True)
class _Expressions:
    bases: dict[str, Column]  # facts that others are worked out from; no line carries them
    facts: dict[str, Column]
    presence: Column
    any_case: list[int]
    candidate_line: Column
    hits: Column
    catalogue: Column


@lru_cache(maxsize=64)
def _expressions(application: str, rules: tuple[Rule, ...]) -> _Expressions:
    """The columns of a pass. They depend on the rules only, and building some thousand
    nodes takes longer than a small scan, so an application keeps them."""
    facts = {fact.name: fact for rule in rules for fact in rule.facts}
    context = Context(
        line=F.col("line"),
        comment=F.col("comment"),
        line_no=F.col("line_no"),
        fact=lambda name: F.col(f"fact_{name}"),
    )
    nothing = F.array().cast("array<string>")
    needles = _needles(rules)

    def hits(number: int, rule: Rule) -> Column:
        wanted = _triggered(rule, needles)
        if rule.skip_comments:
            wanted = wanted & ~F.col("comment")
        found = F.coalesce(F.when(wanted, rule.hits(context)), nothing)
        return F.transform(
            found, lambda text, nth: F.struct(F.lit(number).alias("rule"), text.alias("excerpt"), nth.alias("nth"))
        )

    catalogue = [
        F.struct(
            F.lit(r.rule_id).alias("rule_id"),
            F.lit(r.category).alias("category"),
            F.lit(r.severity).alias("severity"),
            F.lit(r.title).alias("title"),
            F.lit(r.remediation).alias("remediation"),
            F.lit(r.check_order).alias("check_order"),
            F.lit(r.has_line).alias("has_line"),
        )
        for r in rules
    ]
    bases = {fact.of.name: fact.of for fact in facts.values() if fact.of}
    return _Expressions(
        bases={name: _fact_column(fact) for name, fact in bases.items()},
        facts={name: _fact_column(fact) for name, fact in facts.items()},
        presence=_presence(needles),
        any_case=sorted({needles.index(n) for rule in rules if rule.any_case_triggers for n, t in _tests(rule) if t in rule.any_case_triggers}),
        candidate_line=_any_of([_triggered(rule, needles) for rule in rules]),
        hits=F.concat(*[hits(n, r) for n, r in enumerate(rules)]),
        catalogue=F.array(*catalogue),
    )


def _expressions_for(files: DataFrame, rules: Sequence[Rule]) -> _Expressions:
    return _expressions(files.sparkSession.sparkContext.applicationId, tuple(rules))


def candidate_lines(files: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ()) -> DataFrame:
    """Lines worth matching, with their predecessor where it can matter and file facts.

    A file is searched for the rules' literals as a whole; without any it is not split,
    and its lines are searched only for those it has.
    """
    flags = ("is_dockerfile", "is_code", "is_workflow")
    routed = files if set(flags) <= set(files.columns) else route(files)
    expressions = _expressions_for(files, rules)
    content, present = F.col("content"), F.col("present")
    lines = split_lines(content)
    none = F.array().cast("array<string>")
    # Facts are columns of their own before the explode: next to a generator they would
    # be worked out again for every line.
    facts = {f"fact_{name}": column for name, column in expressions.facts.items()}
    bases = {f"fact_{name}": column for name, column in expressions.bases.items()}
    searched = routed.withColumns({"present": expressions.presence, **bases}).withColumns(facts)
    lowered = none
    if expressions.any_case:
        wanted = _any_of([F.get(present, F.lit(i)) for i in expressions.any_case])
        lowered = F.when(wanted, split_lines(F.lower(content))).otherwise(none)
    # The line above is needed only for suppression directives, which few files have.
    above = F.when(
        has_directive(content), F.concat(F.array(F.lit("")), F.slice(lines, F.lit(1), F.size(lines) - 1))
    ).otherwise(none)
    entries = F.when(F.array_contains(present, True), F.arrays_zip(lines, lowered, above))
    exploded = searched.select(
        "repo",
        "path",
        *keep,
        *flags,
        "present",
        *facts,
        # The outer form keeps the optimizer from adding a "not empty" filter, which
        # would search and split every file twice.
        F.posexplode_outer(entries).alias("position", "entry"),
    )
    return exploded.select(
        "repo",
        "path",
        *keep,
        *flags,
        "present",
        *facts,
        (F.col("position") + 1).alias("line_no"),
        F.col("entry")["0"].alias("line"),
        F.col("entry")["1"].alias("lowered"),
        F.col("entry")["2"].alias("above"),
    ).filter(expressions.candidate_line)


def scan_lines(files: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = (), numbered: bool = False) -> DataFrame:
    """Findings of all rules over all lines of the given files, with the file columns named in ``keep``.

    ``numbered`` adds ``nth``, which of its rule's hits on the line a finding is, from 0: unlike
    ``seq_occurrence`` it does not depend on the other rules.
    """
    lines = candidate_lines(files, rules, keep)
    code = F.col("is_code")
    if any(rule.scope == "code" for rule in rules):
        lines = lines.withColumn("comment", code & is_comment_line(F.col("line")))
    else:
        lines = lines.withColumn("comment", F.lit(False))
    # Outer for the same reason as above: the rules must not run twice.
    matched = lines.select(
        "repo",
        "path",
        *keep,
        "line_no",
        "line",
        "above",
        F.posexplode_outer(_expressions_for(files, rules).hits).alias("seq_occurrence", "hit"),
    ).filter(F.col("hit").isNotNull())
    described = matched.withColumn("rule", F.get(_expressions_for(files, rules).catalogue, F.col("hit.rule")))
    return described.select(
        "repo",
        F.col("rule.rule_id").alias("rule_id"),
        F.col("rule.category").alias("category"),
        F.col("rule.severity").alias("severity"),
        F.col("rule.title").alias("title"),
        "path",
        F.when(F.col("rule.has_line"), F.col("line_no")).alias("line"),
        F.col("hit.excerpt").alias("excerpt"),
        F.col("rule.remediation").alias("remediation"),
        F.lit(0).alias("seq_phase"),
        F.col("rule.check_order").alias("seq_check"),
        "seq_occurrence",
        (
            F.col("rule.has_line")
            & (
                covers(F.col("line"), F.col("rule.rule_id"))
                | covers(F.coalesce("above", F.lit("")), F.col("rule.rule_id"))
            )
        ).alias("inline_hit"),
        *keep,
        *([F.col("hit.nth").alias("nth")] if numbered else []),
    )
