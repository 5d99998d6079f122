"""All queries of the llm operators and their SQL."""

from __future__ import annotations

from morphloom.llm import queries, sql

QUERIES = {name: getattr(queries, name) for name in dir(queries) if name[:1] == "p" and name[1:2].isdigit()}
SQL = sql.SQL
