"""Relational operators over record stores: validate, normalise, ingest, read, fold."""
