"""Training-data operators: scoring, de-duplication, extraction, packing, tokenizing, search.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""
