"""Relational and stateful operators over messages and ledgers."""
