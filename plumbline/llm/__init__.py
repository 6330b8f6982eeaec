"""Operators of a training-data pipeline: quality, dedup, mixing, tokens, shards and media.

Nothing outside this subpackage imports it; its queries are in ``plumbline.llm.queries``.
"""
