"""Version specifiers and comparable version keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.functions.text import S_MEMBERS, js_trim

# Fixed value: what still counts as a version after the range prefix is gone.
CONCRETE_VERSION = r"^[0-9]+(?:\.[0-9]+){0,2}(?:[-+][0-9A-Za-z.-]+)?\z"

_VERSION_PARTS = r"^v?([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?\z"


def clean_version(specifier: Column) -> Column:
    return js_trim(F.regexp_replace(specifier, rf"^[\^~>=<{S_MEMBERS}]+", ""))


def is_concrete_version(version: Column) -> Column:
    return version.rlike(CONCRETE_VERSION)


def version_key(version: Column) -> Column:
    """Struct that orders like the version by semver precedence; null if the text is no version.

    ``core`` is major, minor, patch and 0 for a pre-release else 1; missing parts are 0.
    ``pre`` has the parts of the pre-release: numbers come before words and compare by
    length, then digits; of equal beginnings the shorter is less. Build metadata is ignored.
    """

    def part(group: int) -> Column:
        digits = F.regexp_extract(version, _VERSION_PARTS, group)
        return F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("bigint"))

    suffix = F.regexp_extract(version, _VERSION_PARTS, 4)
    released = F.when(suffix == "", 1).otherwise(0)
    core = F.array(part(1), part(2), part(3), released.cast("bigint"))

    def parts(word: Column) -> Column:
        number = word.rlike(r"^[0-9]+\z")
        digits = F.regexp_replace(word, r"^0+(?=[0-9])", "")
        return F.struct(
            F.when(number, 0).otherwise(1).alias("is_word"),
            F.when(number, F.length(digits)).otherwise(0).alias("digits"),
            F.when(number, digits).otherwise(word).alias("text"),
        )

    words = F.filter(F.split(F.substring(suffix, 2, 1 << 20), r"\.", -1), lambda w: w != "")
    key = F.struct(core.alias("core"), F.transform(words, parts).alias("pre"))
    return F.when(version.rlike(_VERSION_PARTS) & ~F.exists(core, lambda p: p.isNull()), key)

