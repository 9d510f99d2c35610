"""Training-data operators: archives, quality, deduplication, packing, sharding.

One module per operator; ``queries`` holds the thin contract queries.  Nothing
else in the library imports this subpackage.
"""
