"""Training-data operators: deduplication, search, sharding, language ID, tokens, chat, URL and benchmark filters.

Nothing outside this package imports it; `queries.py` registers its queries.
"""
