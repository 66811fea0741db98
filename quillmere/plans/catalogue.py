"""Registered queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

from quillmere.plans import documents, retrieval

QUERIES = {**retrieval.QUERIES, **documents.QUERIES}
ORACLE_SQL = {**retrieval.ORACLE_SQL, **documents.ORACLE_SQL}
