"""Dangerous code patterns in JavaScript and TypeScript sources.

A source whose strings, templates, comments and brackets all close is searched for the
construct: in its masked text (see ``functions.code``), which is made once per file, so that
identifiers are matched whole, every occurrence counts, brackets nest to any depth and a
construct may be spread over several lines; it is reported on the line on which it begins.
Shell calls must be bound to ``child_process``.

A source that does not close is one that no parser accepts; its lines are matched with plain
patterns instead, comment lines left out. Both kinds of sources go through one scan. The
plain patterns are rules of their own as well (``FALLBACK_RULES``). Plain URLs are always
looked for line by line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.functions.code import MARK, bracketed, code_text
from wardlake.functions.text import DOT, LEFT, RIGHT, S, construct_lines, excerpt
from wardlake.operators.exec_calls import MODULE, exec_lines
from wardlake.operators.rules import Context, Fact, Rule, once, pattern_rule, repeated

# Ids, titles and remediation texts of the reports.
_EVAL = dict(
    rule_id="misconfig.eval",
    title="Use of eval()",
    severity="high",
    remediation="Avoid eval(); it enables arbitrary code execution. Use JSON.parse or a safe interpreter instead.",
)
_NEW_FUNCTION = dict(
    rule_id="misconfig.new-function",
    title="Dynamic code via new Function()",
    severity="high",
    remediation="new Function() executes arbitrary strings as code. Refactor to avoid dynamic evaluation.",
)
_EXEC = dict(
    rule_id="misconfig.child-process-exec",
    title="child_process.exec with dynamic argument",
    severity="high",
    remediation="Use execFile/spawn with an argument array instead of passing a dynamic string to exec.",
)
_TLS = dict(
    rule_id="misconfig.tls-reject-disabled",
    title="TLS certificate validation disabled",
    severity="critical",
    remediation="Never disable TLS verification in production; it exposes traffic to MITM attacks.",
)
_CORS = dict(
    rule_id="misconfig.cors-wildcard",
    title="Permissive CORS origin '*'",
    severity="medium",
    remediation="Restrict CORS to an explicit allowlist of trusted origins instead of '*'.",
)
_WEAK_RANDOM = dict(
    rule_id="misconfig.weak-random",
    title="Math.random() used for security-sensitive value",
    severity="medium",
    remediation=(
        "Use crypto.randomBytes()/crypto.randomUUID() for tokens and secrets; "
        "Math.random() is not cryptographically secure."
    ),
)
_INSECURE_HTTP = dict(
    rule_id="misconfig.insecure-http",
    title="Hardcoded plaintext http:// URL",
    severity="low",
    remediation="Use https:// for external endpoints to protect data in transit.",
)

# Fixed value: words that make an assigned name security-sensitive.
_SENSITIVE = "token|secret|password|otp|nonce|salt"

# What must stand before, and the construct, in masked code with marked brackets. Where a look back
# comes first, the construct's first letters are looked at before, as that costs less at every place.
_EVAL_CALL = r"(?=[^\w$.]eval)(?<!\.\s{0,20})([^\w$.])(eval\s*(?:\?\.\s*)?\()"
_NEW_FUNCTION_CALL = r"(?=[^\w$.]new)(?<!\.\s{0,20})([^\w$.])(new\s+Function\s*\()"
_TLS_PROPERTY = r"([^\w$.'\"])(rejectUnauthorized\s*:\s*false(?:[^\w$]|\z))"
_TLS_VARIABLE = (
    rf"()((?:\.\s*NODE_TLS_REJECT_UNAUTHORIZED|\[{MARK}\s*\"NODE_TLS_REJECT_UNAUTHORIZED\"\s*\]{MARK})"
    r"\s*=\s*(?:\"0\"|0)(?:[^\w.'\"]|\z))"
)
# The options are the first argument; of their properties only direct ones count.
_CORS_CALL = (
    rf"(?=[^\w$.]cors)(?<!\.\s{{0,20}})([^\w$.])(cors\s*\({MARK}\s*\{{{MARK}(?:(?:[^(){{}}\[\],]|{bracketed(3)})*+,)*?"
    r"\s*origin\s*:\s*\"\*\"\s*[,}])"
)
# An assigned name, a declared one or a property's, and a call that is the whole value: nothing goes on after it.
_RANDOM_ASSIGNED = (
    rf"((?<![\w$])|[{{,]{MARK}?\s*\")((?i:[\w$]*(?:{_SENSITIVE})[\w$]*)(?:\"?\s*:(?<=[{{,]{MARK}?\s{{0,99}}\"?[\w$]{{1,99}}\"?\s{{0,20}}:)"
    r"|\s*(?::\s*[A-Za-z_][\w.<>|\s]*?)?[-+*/%&|^?]{0,2}=)\s*"
    rf"Math\s*\.\s*random\s*(?>\(({MARK})(?s:.*?)\)\3)(?=\s*(?:[;,)}}\]:]|\z)|[^\S\n]*\n\s*[\w$@#\"]))"
)
_PLAIN_URL = r"['\"]http://(?!localhost|127\.0\.0\.1)[^'\"]+['\"]"


def _rule(meta: dict, hits, check_order: int, **options) -> Rule:
    return Rule(
        category="misconfig",
        hits=hits,
        scope="code",
        check_order=check_order,
        **{"skip_comments": True, **meta, **options},
    )


# Without one of these words a source holds no construct in either way and is not masked.
_WORDS = rf"(?=[eFc])(?:{LEFT}(?:eval|Function){RIGHT}|cors)"
_CALLED = rf"(?=exec){LEFT}exec(?:Sync)?{RIGHT}"
_TLS_WORDS = ("rejectUnauthorized", "NODE_TLS_REJECT_UNAUTHORIZED")


def _holds_tls(content: Column) -> Column:
    return content.contains(_TLS_WORDS[0]) | content.contains(_TLS_WORDS[1])


def _worth_masking(content: Column) -> Column:
    words = (content.contains("eval") | content.contains("Function") | content.contains("cors")) & content.rlike(_WORDS)
    calls = content.contains("exec") & (content.contains(MODULE) | content.contains("${")) & content.rlike(_CALLED)
    tls = _holds_tls(content)
    random = content.contains("random") & content.contains("Math") & content.rlike(f"(?i){_SENSITIVE}")
    return words | calls | tls | random


CODE = Fact("code", "code", lambda content, lines: code_text(content), where=_worth_masking)
WHOLE = Fact("whole", "code", lambda code, content: code["whole"], of=CODE)


def _found(name: str, needs: str, lines) -> Fact:
    """The lines on which a construct begins in a source that closes."""
    return Fact(name, "code", lambda code, content: F.when(code["whole"], lines(code["text"], content)), needs=needs, of=CODE)


def _construct(meta: dict, fact: Fact, plain: str, check_order: int, **options) -> Rule:
    """The lines that a fact about the file lists; of a source that doesn't close, those that match ``plain``."""

    def hits(c: Context) -> Column:
        here = F.filter(c.fact(fact.name), lambda line: line == c.line_no)
        broken = ~c.fact(WHOLE.name) & ~c.comment & c.line.rlike(plain)
        return F.when(c.fact(fact.name).isNotNull(), repeated(excerpt(c.line), F.size(here))).otherwise(once(broken, excerpt(c.line)))

    return _rule(meta, hits, check_order, skip_comments=False, facts=(fact, WHOLE), lines=fact, **options)


def _insecure_http_hits(c: Context) -> Column:
    return once(c.line.rlike(_PLAIN_URL), excerpt(c.line))


# What a line must hold in a source that no parser accepts.
_EVAL_LINE = rf"{LEFT}eval{S}*\("
_NEW_FUNCTION_LINE = rf"{LEFT}new{S}+Function{S}*\("
_EXEC_LINE = rf"{LEFT}exec(?:Sync)?{S}*\({S}*[`'\"]{DOT}*\$\{{"
_TLS_LINE = rf"NODE_TLS_REJECT_UNAUTHORIZED{S}*[:=]{S}*['\"]?0|rejectUnauthorized{S}*:{S}*false"
_CORS_LINE = rf"cors{S}*\({S}*\{{[^}}]*origin{S}*:{S}*['\"]\*['\"]"
_RANDOM_LINE = rf"(?i){LEFT}(?:{_SENSITIVE}){RIGHT}[^\n;]*Math\.random{S}*\("


def _tls(code: Column, content: Column) -> Column:
    lines = F.concat(construct_lines(code["text"], _TLS_PROPERTY), construct_lines(code["text"], _TLS_VARIABLE))
    return F.when(code["whole"] & _holds_tls(content), lines)


EVAL = _construct(_EVAL, _found("eval_lines", "eval", lambda code, _: construct_lines(code, _EVAL_CALL)), _EVAL_LINE, 20, triggers=("eval",))
NEW_FUNCTION = _construct(
    _NEW_FUNCTION,
    _found("function_lines", "Function", lambda code, _: construct_lines(code, _NEW_FUNCTION_CALL)),
    _NEW_FUNCTION_LINE,
    21,
    triggers=("Function", "new"),
    needs="Function",
)
EXEC = _construct(_EXEC, _found("exec_lines", MODULE, exec_lines), _EXEC_LINE, 22, triggers=("exec",))
# Both spellings, rejectUnauthorized and NODE_TLS_REJECT_UNAUTHORIZED, in one search.
_TLS_NAMES = ("unauthorized",)
TLS = _construct(_TLS, Fact("tls_lines", "code", _tls, of=CODE), _TLS_LINE, 23, any_case_triggers=_TLS_NAMES)
CORS = _construct(_CORS, _found("cors_lines", "cors", lambda code, _: construct_lines(code, _CORS_CALL)), _CORS_LINE, 24, triggers=("cors",))
# The name may stand on another line than the call.
WEAK_RANDOM = _construct(
    _WEAK_RANDOM,
    _found("random_lines", "random", lambda code, _: construct_lines(code, _RANDOM_ASSIGNED)),
    _RANDOM_LINE,
    25,
    any_case_triggers=tuple(_SENSITIVE.split("|")),
    needs="random",
)
INSECURE_HTTP = _rule(_INSECURE_HTTP, _insecure_http_hits, 26, triggers=("http://",))

CODE_RULES = [EVAL, NEW_FUNCTION, EXEC, TLS, CORS, WEAK_RANDOM, INSECURE_HTTP]


def _fallback(meta: dict, pattern: str, triggers: tuple[str, ...] = (), **options) -> Rule:
    return pattern_rule(
        category="misconfig",
        pattern=pattern,
        per_line=True,
        scope="code",
        skip_comments=True,
        triggers=triggers,
        check_order=20,
        **meta,
        **options,
    )


EVAL_FALLBACK = _fallback(_EVAL, _EVAL_LINE, ("eval",))
NEW_FUNCTION_FALLBACK = _fallback(_NEW_FUNCTION, _NEW_FUNCTION_LINE, ("Function",))
EXEC_FALLBACK = _fallback(_EXEC, _EXEC_LINE, ("exec",))
TLS_FALLBACK = _fallback(_TLS, _TLS_LINE, any_case_triggers=_TLS_NAMES)
CORS_FALLBACK = _fallback(_CORS, _CORS_LINE, ("cors",))
WEAK_RANDOM_FALLBACK = _fallback(_WEAK_RANDOM, _RANDOM_LINE, any_case_triggers=("math.random",))

FALLBACK_RULES = [
    EVAL_FALLBACK,
    NEW_FUNCTION_FALLBACK,
    EXEC_FALLBACK,
    TLS_FALLBACK,
    CORS_FALLBACK,
    WEAK_RANDOM_FALLBACK,
    INSECURE_HTTP,
]
