"""Training-data operators: one module per operator, each with its registered query.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
