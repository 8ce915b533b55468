"""Registered queries over the test tables, with the SQL that gives the same rows."""

from . import archives, relational, sessions, vectors

QUERIES: dict = {**archives.QUERIES, **relational.QUERIES, **sessions.QUERIES, **vectors.QUERIES}
ORACLE: dict[str, str] = {**archives.ORACLE, **relational.ORACLE, **sessions.ORACLE, **vectors.ORACLE}
