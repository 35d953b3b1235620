"""Operators of a training-data pipeline: tokens, archives, shards, near copies, quality, mixing.

Nothing outside this folder imports it; `__spark_entry__.py` adds its queries when it is there.
"""
