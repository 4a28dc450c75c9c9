"""Registered queries over the given tables, and SQL that must give the same rows."""
