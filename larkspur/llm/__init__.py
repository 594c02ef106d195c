"""Operators of a training-data pipeline.

Nothing outside this folder imports it; :mod:`larkspur.llm.queries` registers
its queries, and ``__spark_entry__.py`` adds them where this folder exists.
"""
