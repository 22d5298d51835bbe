"""wardlake: security analytics over tables of source files, as Spark jobs.

Every operator takes and returns DataFrames keyed by ``repo``; see
``wardlake.plans.scan.scan`` for the whole scan and ``wardlake.plans.report``
for the reports.
"""

__version__ = "0.1.0"
