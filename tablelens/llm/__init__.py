"""Operators for preparing training data.

Each module holds one operator with its general interface; ``queries`` applies
them to the given tables and ``oracles`` asks the same in SQL where SQL can.
Nothing outside this package imports it.
"""
