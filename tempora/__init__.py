"""Dated-event analytics on PySpark: extraction, search, timelines, keyed edits and per-key streams."""
