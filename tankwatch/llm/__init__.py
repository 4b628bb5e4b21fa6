"""Operators for training-data pipelines over text, embeddings and URLs.

Nothing outside this package imports it; ``queries`` lists its registered queries.
"""
