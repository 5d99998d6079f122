"""All queries of the core and their SQL."""

from __future__ import annotations

from morphloom.plans import corpus, grammar, induction, lexical, review, tickets, work

PARTS = (tickets, corpus, grammar, review, lexical, induction, work)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
SQL = {name: text for part in PARTS for name, text in part.SQL.items()}
