"""ledgerlens: transaction-risk analytics written as Spark DataFrame jobs.

Layers (each a set of ``DataFrame -> DataFrame`` functions):

* ``sources``    – readers for raw payloads, the driver test tables, streams; sinks.
* ``functions``  – column expressions (validation, normalisation, formatting).
* ``operators``  – ingestion, features, enrichment joins, rules, decisions,
                   identity graph, monitoring tables, ML.
* ``plans``      – end-to-end jobs and the registered query catalogue.
* ``streaming``  – Structured Streaming versions of the same jobs.
"""

__version__ = "0.1.0"
