"""Hardcoded secrets: rules over every scanned file, one finding per occurrence."""

from __future__ import annotations

from wardlake.functions.text import S
from wardlake.operators.rules import Rule, pattern_rule

_ROTATE = "Remove the value from the source, rotate it, and load it from a secret store at run time."


def _secret(name: str, severity: str, title: str, pattern: str, group: int = 0, **options) -> Rule:
    return pattern_rule(
        f"secret.{name}",
        "secret",
        severity,
        title,
        _ROTATE,
        pattern,
        group,
        check_order=0,
        **options,
    )


AWS_ACCESS_KEY = _secret(
    "aws-access-key", "critical", "AWS access key", r"AKIA[0-9A-Z]{16}", triggers=("AKIA",)
)
PRIVATE_KEY = _secret(
    "private-key",
    "critical",
    "Private key",
    r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    triggers=("PRIVATE KEY-----",),
)
API_KEY = _secret(
    "api-key",
    "high",
    "Hardcoded API key",
    rf"(?i)api[_-]?key['\"]?{S}*[:=]{S}*['\"]([A-Za-z0-9_-]{{16,}})['\"]",
    1,
    any_case_triggers=("apikey", "api_key", "api-key"),
)
JWT_SECRET = _secret(
    "jwt-secret",
    "high",
    "Hardcoded JWT secret",
    rf"(?i)jwt[_-]?secret['\"]?{S}*[:=]{S}*['\"]([^'\"]{{8,}})['\"]",
    1,
    any_case_triggers=("jwt",),
)
BEARER_TOKEN = _secret(
    "bearer-token",
    "high",
    "Hardcoded bearer token",
    rf"(?i)bearer{S}+([A-Za-z0-9._~+/-]{{16,}})",
    1,
    any_case_triggers=("bearer",),
)
HARDCODED_PASSWORD = _secret(
    "hardcoded-password",
    "high",
    "Hardcoded password",
    rf"(?i)(?:password|passwd|pwd)['\"]?{S}*[:=]{S}*['\"]([^'\"]{{6,}})['\"]",
    1,
    any_case_triggers=("passw", "pwd"),
)

SECRET_RULES = [AWS_ACCESS_KEY, PRIVATE_KEY, API_KEY, JWT_SECRET, BEARER_TOKEN, HARDCODED_PASSWORD]

# Not in the default catalogue: a rule a user adds through the extension point.
GENERIC_TOKEN = _secret(
    "generic-token",
    "medium",
    "Hardcoded token",
    rf"(?i)token['\"]?{S}*[:=]{S}*['\"]([A-Za-z0-9]{{32,}})['\"]",
    1,
    any_case_triggers=("token",),
)
