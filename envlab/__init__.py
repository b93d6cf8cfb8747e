"""envlab: multi-environment text-classification data jobs on Spark DataFrames.

Subpackages
-----------
functions  Column-expression builders (seeded draws, tokenising, prefix injection,
           run-name parsing, probability maths).
sources    Readers: corpora, environment TSV files, metric logs, run histories, fixtures.
sinks      Writers: environment TSV files, reports, metric logs, encoded datasets.
operators  Reusable DataFrame -> DataFrame operators (ranking, balancing, metrics, ...).
plans      Composite jobs a user calls (corpus builders, reports, aggregations).
streaming  Structured Streaming versions of the incremental metric-log jobs.
checks     SQL twins of the registered queries (DuckDB dialect) used as an oracle.
"""

__version__ = "0.1.0"
