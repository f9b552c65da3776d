"""All registered queries but those of the training-data operators."""

from __future__ import annotations

from . import corpus_queries, language_queries, lexing_queries, pairing_queries, storage_queries, triage_queries

MODULES = (triage_queries, corpus_queries, pairing_queries, lexing_queries, language_queries, storage_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
