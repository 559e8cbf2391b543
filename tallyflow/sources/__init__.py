"""Readers for files, relational tables and topics."""
