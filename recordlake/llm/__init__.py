"""Training-data operators: deduplication, filtering, tokenising, packing, archives.

Each operator is a function from DataFrames to a DataFrame with its own general
parameters; ``queries`` applies every one of them to its whole table. Nothing
outside this subpackage imports it.
"""
