"""The scan over arriving files: the same narrow rules on a stream of file rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardlake.model import public
from wardlake.operators.rules import Rule, scan_lines
from wardlake.plans.scan import DEFAULT_RULES
from wardlake.sources.corpus import scanned_files

ARRIVALS_SCHEMA = "repo string, path string, size long, content string, arrived_at timestamp"


def read_arrivals(spark: SparkSession, source: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of file rows from parquet files that appear in a folder."""
    reader = spark.readStream.schema(ARRIVALS_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(source)


def scan_stream(arrivals: DataFrame, rules: Sequence[Rule] = tuple(DEFAULT_RULES)) -> DataFrame:
    """Findings of every arriving file, however late, with ``digest`` of the file's content and ``nth``.

    Findings carry ``inline_hit``; ignore files and fingerprints belong to a whole repository
    and are applied to the stored findings. This part has no state.
    """
    return scan_lines(scanned_files(arrivals).withColumn("digest", F.sha2("content", 256)), rules, ("digest",), numbered=True)


#: What makes a finding of one version of a file the same as one stored before.
FINDING_KEY = ("repo", "path", "digest", "rule_id", "line", "excerpt", "nth")


def new_findings(findings: DataFrame) -> DataFrame:
    """Findings not seen before in this stream, with ``in_source``: a directive in the file covers it.

    The state is keyed by finding: file, digest, rule, line, excerpt and number. A file that
    arrives again adds what the rules of this run find in it beyond what is stored: nothing
    if neither its text nor the rules changed, the hits of added or changed rules otherwise.
    Nothing is too late, as there is no watermark. The state grows with the stored findings, a
    few hundred bytes each, spread over all shuffle partitions; files without findings leave none.
    """
    once = findings.dropDuplicates(list(FINDING_KEY))
    return public(once.withColumn("in_source", F.col("inline_hit")), "in_source", "digest")


def store_findings(findings: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append new findings to a parquet table, taking everything available and then stopping.

    What is stored already is known from the state below ``checkpoint``, so the table itself
    is never read. State and sink are both bound to the batch number: a batch that is run
    again after a failure leaves the same rows once. The number of shuffle partitions is
    fixed by the first run of a checkpoint.
    """
    writer = new_findings(findings).writeStream.format("parquet").outputMode("append")
    return writer.option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
