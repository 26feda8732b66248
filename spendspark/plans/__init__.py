"""Composed queries and the ledgers that they run on."""
