"""Queries over the test tables, with the SQL that each is held against."""
