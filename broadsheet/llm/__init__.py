"""Training-data operators: mixing, language, duplicates, extraction, scoring, packing, fingerprints.

Nothing outside this folder imports it.  Each module holds one operator with
its own interface; ``queries`` and ``oracles`` register them.
"""
