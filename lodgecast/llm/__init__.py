"""Operators for preparing training data; nothing else in the library imports this package.

Column names that begin with ``_llm_`` are reserved for the operators; any other extra column is
carried along or ignored.
"""
