"""Spark jobs over bank messages, statements and ledgers."""
