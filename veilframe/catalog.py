"""Registered queries of the de-identification operators, with the SQL that checks them."""

from __future__ import annotations

from .plans import decoding, detection, documents, identifiers, pages, policy, reporting, reports, texts

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (identifiers, documents, texts, detection, policy, pages, reports, reporting, decoding):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
