"""All queries of the core, by name, and the SQL that checks them."""

from __future__ import annotations

from airloom.plans import exchange, flows, formats, functions, records, reference, training

QUERIES = {**training.QUERIES, **reference.QUERIES, **formats.QUERIES, **functions.QUERIES, **flows.QUERIES, **records.QUERIES, **exchange.QUERIES}
SQL = {**training.SQL, **reference.SQL, **formats.SQL, **functions.SQL, **flows.SQL, **records.SQL, **exchange.SQL}
