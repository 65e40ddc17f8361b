"""Registered queries: views over the tables, one query per operator, and the same in SQL."""
