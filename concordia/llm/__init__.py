"""Training-data operators (near-dedup, scans, formatting, mixing, tokens, vectors).

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries when it can be imported.
"""
