"""The user-facing queries, composed from operators and functions."""
