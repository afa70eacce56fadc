"""Operators for preparing large-scale training data.

Nothing outside this subpackage imports it.  Each module holds one operator with its own
general interface; :mod:`quillspark.llm.queries` derives the registered queries from them.
"""
