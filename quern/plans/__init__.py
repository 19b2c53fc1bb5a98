"""Queries over the tables, each with the same question in SQL where SQL can ask it."""
