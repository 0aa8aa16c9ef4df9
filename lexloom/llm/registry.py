"""Registered queries of the training-data operators, one a contract, and SQL where SQL expresses them."""

from __future__ import annotations

from lexloom.llm import contracts


def queries():
    return dict(contracts.QUERIES)


def oracle_sql():
    return dict(contracts.SQL)
