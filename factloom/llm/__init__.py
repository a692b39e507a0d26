"""Training-data operators: token counts, encoding, deduplication, scans and scoring.

Nothing else in the library imports this subpackage.  The registered queries
and their SQL are in :mod:`factloom.llm.queries`.
"""
