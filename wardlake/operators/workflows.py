"""CI workflow rules: unpinned actions, and checkouts under a privileged trigger."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.functions.text import NS, S, js_trim
from wardlake.operators.rules import Context, Fact, Rule, once

# Ids, titles and remediation texts of the reports.
_UNPINNED = dict(
    rule_id="misconfig.gha-unpinned-action",
    title="Unpinned GitHub Actions version",
    severity="medium",
    remediation=(
        "Pin actions to a full commit SHA instead of a mutable tag "
        "(e.g. `uses: actions/checkout@11bd71901bbe5b1630ceea73d27597364c9af683`). "
        "Tags can be moved to point to different (potentially malicious) code."
    ),
)
_PWN_REQUEST = dict(
    rule_id="misconfig.gha-pwn-request",
    title="pull_request_target with actions/checkout (pwn-request vector)",
    severity="high",
    remediation=(
        "Combining `pull_request_target` with `actions/checkout` of the PR head "
        "runs untrusted code with elevated repository permissions. "
        "Use `pull_request` instead, or if elevated permissions are required, "
        "build and test in a separate job that does not check out PR code."
    ),
)

# Fixed value: the privileged trigger.
_TRIGGER = "pull_request_target"

_USES = rf"^{S}*(?:-{S}+)?uses:{S}+({NS}+){S}*\z"
_CHECKOUT = rf"uses:{S}+['\"]?actions/checkout"


def without_comment(line: Column) -> Column:
    """A YAML line up to its first ``#``, quoted or not."""
    return F.substring_index(line, "#", 1)


def action_reference(line: Column) -> Column:
    """What a ``uses:`` line refers to, without quotes; '' on other lines."""
    reference = F.regexp_extract(without_comment(line), _USES, 1)
    return F.regexp_replace(reference, r"^['\"]|['\"]\z", "")


def is_unpinned(reference: Column) -> Column:
    pin = F.substring_index(reference, "@", -1)
    return (
        reference.contains("@") & ~reference.startswith("docker://") & ~pin.rlike(r"^[0-9a-f]{40}\z")
    )


def _first_trigger_line(content: Column, lines: Column) -> Column:
    """Number of the first line naming the trigger, if a checkout is there too."""
    named = F.transform(
        lines, lambda line, i: F.when(without_comment(line).contains(_TRIGGER), i + 1)
    )
    checkout = F.exists(lines, lambda line: without_comment(line).rlike(_CHECKOUT))
    return F.when(checkout, F.array_min(named))


def _unpinned_hits(c: Context) -> Column:
    return once(is_unpinned(action_reference(c.line)), js_trim(c.line))


def _pwn_hits(c: Context) -> Column:
    return once(c.fact("trigger_line") == c.line_no, js_trim(c.line))


def _rule(meta: dict, hits, check_order: int, **options) -> Rule:
    return Rule(
        category="misconfig", hits=hits, scope="workflow", check_order=check_order, **meta, **options
    )


UNPINNED_ACTION = _rule(_UNPINNED, _unpinned_hits, 30, triggers=("uses:",))
PWN_REQUEST = _rule(
    _PWN_REQUEST,
    _pwn_hits,
    31,
    triggers=(_TRIGGER,),
    facts=(Fact("trigger_line", "workflow", _first_trigger_line, needs=_TRIGGER),),
)

WORKFLOW_RULES = [UNPINNED_ACTION, PWN_REQUEST]
