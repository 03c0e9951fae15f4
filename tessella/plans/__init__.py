"""Queries built from the operators, with the SQL they are compared with."""
