"""Queries bound to the test tables, each beside the SQL that checks it."""
