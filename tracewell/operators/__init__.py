"""Relational and stateful operators over the call log."""
