"""recordlake — a Spark-native engine for feeds of semi-structured records.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
Spark SQL built-ins; session-wide settings live in :mod:`recordlake.session`.
"""

__version__ = "0.1.0"
