"""Training-data operators: deduplication, filtering, extraction, packing, sharding, embeddings.

Thirteen operators, one module each; ``queries`` registers one query per operator
(and, where SQL can express it, its DuckDB text).  Nothing else in the library
imports this subpackage.
"""
