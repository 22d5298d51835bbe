"""Time the headline queries and print one JSON line.

Every query runs once, to a sink that takes all rows; building the stored inputs from
the given tables is timed as an entry of its own.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import planted as P  # noqa: E402
from checks.queries import QUERIES  # noqa: E402
from wardlake.session import session_builder  # noqa: E402

HEADLINE = (
    "explode_lines",
    "secret_findings",
    "misconfig_findings",
    "dockerfile_findings",
    "gha_findings",
    "scan_texts",
    "resolved_dependencies",
    "dependency_findings",
    "cvss_base_score",
    "apply_suppressions",
    "changed_files",
    "diff_scan",
    "all_findings",
    "scan_summary",
    "severity_counts",
    "finding_fingerprints",
    "sarif_document",
    "json_report",
)


def build_inputs(spark, sf_dir: str) -> None:
    for build in (P.corpus, P.texts, P.tracked, P.advisories, P.snapshots):
        build(spark, sf_dir)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.enabled": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    spark = session_builder("bench", **settings).master(f"local[{cpus}]").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}

    def timed(name: str, action) -> None:
        start = time.perf_counter()
        action()
        timings[name] = round(time.perf_counter() - start, 3)

    timed("build_inputs", lambda: build_inputs(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda q=QUERIES[name]: q(spark, sf_dir).write.format("noop").mode("overwrite").save())
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
