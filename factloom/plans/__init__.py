"""Registered queries: each module holds QUERIES (name -> function of session and folder) and ORACLES (name -> SQL)."""

from __future__ import annotations

from factloom.plans import audits, control, decisions, documents, measures, publishing, relations, streams

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (decisions, relations, measures, documents, publishing, streams, control, audits):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
