"""Training-data operators: sharding, token files, cleaning, dedup and tagging.

Nothing outside this folder imports it; `__spark_entry__` adds its queries when
it is present.
"""
