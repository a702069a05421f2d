"""Registered queries and their SQL twins."""

from attesta.catalog import q_jobs, q_relations, q_reports, q_sources, q_text, views  # noqa: F401
from attesta.catalog.core import QUERIES, Tables, oracle_text, runner  # noqa: F401
