"""Dockerfile rules: base image tags, the final stage's user, secrets in ENV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.functions.text import NS, RIGHT, S, js_trim
from wardlake.operators.rules import Context, Fact, Rule, once
from wardlake.sources.corpus import explode_lines, route

# Ids, titles and remediation texts of the reports.
_LATEST_TAG = dict(
    rule_id="misconfig.dockerfile-latest-tag",
    title="Unpinned base image tag",
    severity="low",
    remediation=(
        "Pin base images to an immutable version tag or digest (e.g. `ubuntu:22.04` or "
        "`ubuntu@sha256:...`) to prevent unexpected changes when the image is rebuilt."
    ),
)
_ROOT_USER = dict(
    rule_id="misconfig.dockerfile-root-user",
    title="Container runs as root",
    severity="medium",
    remediation=(
        "Add a USER instruction after package installation to run the container as a non-root "
        "user (e.g. `RUN useradd -u 1001 appuser && USER appuser`)."
    ),
)
_ENV_SECRET = dict(
    rule_id="misconfig.dockerfile-env-secret",
    title="Potential secret in ENV instruction",
    severity="high",
    remediation=(
        "Do not store secrets in Dockerfile ENV instructions — they are baked into image layers "
        "and visible in `docker inspect`. Pass secrets at runtime via orchestrator secrets or "
        "environment variables."
    ),
)

# Fixed value: names of ENV keys that hold credentials.
_SECRET_KEY = (
    r"(?i)(?:password|passwd|secret|token|api[_-]?key|auth(?:_?key)?|private[_-]?key"
    rf"|credentials?|access[_-]?key|client[_-]?secret){RIGHT}"
)

_FROM = rf"(?i)^FROM{S}+(?:--{NS}+{S}+)*({NS}+)"
_USER = rf"(?i)^USER{S}+({NS}+)"
_PAIR = rf"(?:^|{S})[A-Za-z_][A-Za-z0-9_]*={NS}*"


def base_image(line: Column) -> Column:
    """Image of a FROM instruction, '' on other lines."""
    return F.regexp_extract(js_trim(line), _FROM, 1)


def is_unpinned(image: Column) -> Column:
    """No digest, and after the first colon nothing or ``latest``."""
    tag = F.substring(image, F.locate(":", image) + 1, F.length(image))
    return (
        (image != "")
        & (F.lower(image) != "scratch")
        & ~image.contains("@")
        & (~image.contains(":") | (tag == "latest"))
    )


def sets_plain_user(line: Column) -> Column:
    """A USER instruction that names anyone but root; zero in any spelling is root."""
    who = F.substring_index(F.regexp_extract(js_trim(line), _USER, 1), ":", 1)
    named = js_trim(line).rlike(_USER)
    return named & (who != "root") & ~who.rlike(r"^[+-]?0+(?:[^0-9]|\z)")


def _runs_as_root(content: Column, lines: Column) -> Column:
    """No plain user in the final stage; once set, a stage keeps it."""
    starts = F.transform(lines, lambda line, i: F.when(base_image(line) != "", i))
    last_start = F.coalesce(F.array_max(starts), F.lit(-1))
    final_stage = F.slice(lines, last_start + 2, F.size(lines))
    return ~F.exists(final_stage, sets_plain_user)


def _looks_secret(key: Column, value: Column) -> Column:
    return key.rlike(_SECRET_KEY) & ~value.isin("", '""', "''") & ~value.startswith("$")


def _env_hits(c: Context) -> Column:
    line = js_trim(c.line)
    body = js_trim(F.substring(line, 5, 2**31 - 1))
    first = F.regexp_extract(body, rf"^{NS}*", 0)

    def pair(text: Column) -> Column:
        key = js_trim(F.substring_index(text, "=", 1))
        value = F.substring(text, F.locate("=", text) + 1, F.length(text))
        return F.when(_looks_secret(key, value), F.concat(F.lit("ENV "), key, F.lit("=***")))

    pairs = F.transform(F.regexp_extract_all(body, F.lit(_PAIR), F.lit(0)), pair)
    rest = js_trim(F.substring(body, F.length(first) + 2, F.length(body)))
    single = F.when(
        (F.length(body) > F.length(first)) & _looks_secret(first, rest),
        F.array(F.concat(F.lit("ENV "), first, F.lit(" ***"))),
    )
    hits = F.when(first.contains("="), F.filter(pairs, lambda p: p.isNotNull())).otherwise(single)
    return F.when(line.rlike(rf"(?i)^ENV{S}"), hits)


def _latest_hits(c: Context) -> Column:
    return once(is_unpinned(base_image(c.line)), js_trim(c.line))


def _root_hits(c: Context) -> Column:
    return once(c.fact("root_user"), F.lit(None).cast("string"))


def _rule(meta: dict, hits, check_order: int, **options) -> Rule:
    return Rule(category="misconfig", hits=hits, scope="docker", check_order=check_order, **meta, **options)


LATEST_TAG = _rule(_LATEST_TAG, _latest_hits, 10, trigger_pattern=rf"(?i)^{S}*FROM{S}")
ENV_SECRET = _rule(_ENV_SECRET, _env_hits, 10, trigger_pattern=rf"(?i)^{S}*ENV{S}")
ROOT_USER = _rule(
    _ROOT_USER,
    _root_hits,
    11,
    has_line=False,
    facts=(Fact("root_user", "docker", _runs_as_root),),
)

DOCKER_RULES = [LATEST_TAG, ENV_SECRET, ROOT_USER]


def docker_stages(files: DataFrame) -> DataFrame:
    """Lines of Dockerfiles with the number of the build stage they belong to.

    Stage 0 is what stands above the first FROM. The window is per file, so its groups
    are as small as a scanned file is.
    """
    lines = explode_lines(route(files).filter("is_dockerfile"))
    image = base_image(F.col("line"))
    so_far = Window.partitionBy("repo", "path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select(
        "repo",
        "path",
        "line_no",
        F.nullif(image, F.lit("")).alias("image"),
        F.sum(F.when(image != "", 1).otherwise(0)).over(so_far).alias("stage"),
        sets_plain_user(F.col("line")).alias("sets_plain_user"),
    )
