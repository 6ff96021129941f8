"""Files, dictionaries and rules as tables."""
