"""Training-data operators: language ID, similarity joins, filters, dedup, decontamination, packing.

Each module holds one operator with its own general interface; ``catalog``
holds the thin queries and the SQL that checks them.
"""
