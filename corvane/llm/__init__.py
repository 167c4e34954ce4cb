"""Operators for preparing language-model training text.

Nothing else in the library imports this subpackage; its queries and SQL are in
:mod:`corvane.llm.registry`.
"""
