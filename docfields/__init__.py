"""docfields: document-field analytics as Spark DataFrame operators.

Every operator is a plain function ``DataFrame(s) -> DataFrame`` built from
Spark SQL expressions, joins, aggregations and windows.  Sub-packages:

* ``functions``  -- Column -> Column scalar helpers (text, hashing, dates)
* ``sources``    -- table loading, derived fixtures, sinks, binary ingest
* ``operators``  -- locate, fields, edits, tables, report, retrieve, lifecycle, usage
* ``plans``      -- composite pipelines Q1..Q6 and the query registry
* ``streaming``  -- Structured Streaming forms (chat fold, incremental ingest, stats)
"""

__version__ = "0.1.0"
