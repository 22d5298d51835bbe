"""CVSS v3 base score of a vector string, as one Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.functions.text import bind

# Base metric weights of the CVSS v3.1 specification, section 7.4.
ATTACK_VECTOR = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
ATTACK_COMPLEXITY = {"L": 0.77, "H": 0.44}
USER_INTERACTION = {"N": 0.85, "R": 0.62}
IMPACT = {"H": 0.56, "L": 0.22, "N": 0.0}
PRIVILEGES_SCOPE_UNCHANGED = {"N": 0.85, "L": 0.62, "H": 0.27}
PRIVILEGES_SCOPE_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.5}


def _metric(vector: Column, name: str) -> Column:
    """Value of a metric; the last one counts when it is repeated."""
    values = F.regexp_extract_all(vector, F.lit(f"/{name}:([^:/]+)"), F.lit(1))
    return F.get(values, F.size(values) - 1)


def _weight(letter: Column, table: dict[str, float]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), letter)


def _round_up(score: Column) -> Column:
    """Smallest one-decimal number that is not below the score (specification, appendix A)."""
    scaled = F.floor(score * 100000 + 0.5)
    exact = scaled / F.lit(100000.0)
    above = (F.floor(scaled / F.lit(10000)) + 1) / F.lit(10.0)
    return F.when(scaled % 10000 == 0, exact).otherwise(above)


def cvss_base_score(vector: Column) -> Column:
    """Base score 0..10, or null for other versions and incomplete vectors.

    The steps are bound one after the other: written as one formula, each would repeat
    the steps it builds on, and the expression would grow out of proportion.
    """
    privileges = _metric(vector, "PR")
    metrics = F.struct(
        _metric(vector, "S").alias("scope"),
        _weight(_metric(vector, "AV"), ATTACK_VECTOR).alias("av"),
        _weight(_metric(vector, "AC"), ATTACK_COMPLEXITY).alias("ac"),
        _weight(privileges, PRIVILEGES_SCOPE_UNCHANGED).alias("pr_unchanged"),
        _weight(privileges, PRIVILEGES_SCOPE_CHANGED).alias("pr_changed"),
        _weight(_metric(vector, "UI"), USER_INTERACTION).alias("ui"),
        *[_weight(_metric(vector, m), IMPACT).alias(m.lower()) for m in ("C", "I", "A")],
    )

    def parts(m: Column) -> Column:
        pr = F.when(m["scope"] == "C", m["pr_changed"]).otherwise(m["pr_unchanged"])
        lost = 1 - (1 - m["c"]) * (1 - m["i"]) * (1 - m["a"])
        return F.struct(
            m["scope"].alias("scope"),
            lost.alias("lost"),
            (F.lit(8.22) * m["av"] * m["ac"] * pr * m["ui"]).alias("exploitability"),
        )

    def totals(p: Column) -> Column:
        lost = p["lost"]
        changed = 7.52 * (lost - 0.029) - 3.25 * F.pow(lost - 0.02, F.lit(15.0))
        return F.struct(
            F.when(p["scope"] == "C", changed).otherwise(6.42 * lost).alias("impact"),
            F.when(p["scope"] == "C", 1.08).otherwise(1.0).alias("factor"),
            p["exploitability"].alias("exploitability"),
        )

    def score(t: Column) -> Column:
        total = F.least(t["factor"] * (t["impact"] + t["exploitability"]), F.lit(10.0))
        rounded = F.when(t["impact"] <= 0, F.lit(0.0)).otherwise(_round_up(total))
        return F.when(t["impact"].isNotNull() & t["exploitability"].isNotNull(), rounded)

    readable = vector.rlike(r"^CVSS:3\.[01]/") & _metric(vector, "S").isin("U", "C")
    return F.when(readable, bind(bind(bind(metrics, parts), totals), score))


def advisory_severity(label: Column, entries: Column) -> Column:
    """Severity of an advisory: its database label, else its first CVSS v3 entry, else medium."""
    first_v3 = F.get(F.filter(entries, lambda e: e["type"].startswith("CVSS_V3")), F.lit(0))
    from_score = bind(
        cvss_base_score(first_v3["score"]),
        lambda score: F.when(score >= 9, "critical")
        .when(score >= 7, "high")
        .when(score >= 4, "medium")
        .when(score.isNotNull(), "low")
        .otherwise("medium"),
    )
    upper = F.upper(label)
    return (
        F.when(upper == "CRITICAL", "critical")
        .when(upper == "HIGH", "high")
        .when(upper.isin("MODERATE", "MEDIUM"), "medium")
        .when(upper == "LOW", "low")
        .otherwise(from_score)
    )
