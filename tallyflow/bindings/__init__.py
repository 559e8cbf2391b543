"""Shapes the provided test tables into the three data domains."""
