"""Reusable DataFrame operators: keyed loads, sessions, cleaning, ranking."""
