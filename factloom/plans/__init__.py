"""Registered queries: every operator on the given tables, with its SQL twin where SQL can say it."""
