"""Training-data operators: language ID, deduplication, quality, chat, BPE, secrets, decontamination.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
queries that ``__spark_entry__.py`` registers.
"""
