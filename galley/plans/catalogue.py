"""Registry of the core's queries."""

from __future__ import annotations

from . import compare, games, records, relational, text, words

QUERIES: dict = {**records.QUERIES, **text.QUERIES, **relational.QUERIES, **games.QUERIES, **compare.QUERIES, **words.QUERIES}
SQL: dict[str, str] = {**records.SQL, **text.SQL, **relational.SQL, **games.SQL, **compare.SQL, **words.SQL}
