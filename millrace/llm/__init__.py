"""Operators for building training corpora.

Nothing outside this subpackage imports it; `millrace.llm.queries` registers
its queries, and `corpus_pipeline.py` chains five of the operators.
"""
