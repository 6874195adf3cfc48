"""Queries that show each operator on the test tables, with SQL that states the same result."""
