"""Operators of a large-scale training-data pipeline.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
Each module holds one operator with a general interface, and the thin query
``opN_<name>`` that applies it to a whole table.  ``catalog`` lists the queries.
"""
