"""Registered queries over the source tables, and the SQL each must agree with."""
