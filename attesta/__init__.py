"""attesta: governed document collections on Spark.

Table-in / table-out operators for source governance, ingestion, retrieval,
grounding, evaluation, privacy, reporting and retention.
"""
