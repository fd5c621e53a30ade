"""Operators for preparing training data: text in, decisions and digests out.

Each module holds one operator with a general interface; ``queries`` registers
the thin queries that apply them to the test tables, and ``oracle`` their SQL
twins where SQL can express them.
"""
