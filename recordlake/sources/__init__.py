"""Readers: JSON lines, whole-file responses, landing folders, stores, test-table adapters."""
