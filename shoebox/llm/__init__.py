"""Operators for training-data pipelines.

Nothing outside this subpackage imports it.  Each operator module has a
general interface over any DataFrame; ``shoebox.llm.entry`` has the
thin queries that apply them to the corpus tables.
"""
