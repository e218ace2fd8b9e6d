"""Operators for preparing training text: deduplication, packing, classification, archives, tokenising.

Each module holds one operator on DataFrames; ``queries.py`` registers one query per operator.
Nothing outside this subpackage imports it (``__spark_entry__.py`` adds its queries when present).
"""
