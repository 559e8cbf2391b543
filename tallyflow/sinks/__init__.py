"""Writers: keyed tables, report folders, topics and minute files."""
