"""Operators on training text: filtering, de-duplication, tokenising, classifying and rendering.

Each module holds one operator with a general interface; ``queries`` registers the thin queries on the given tables.
Nothing outside this package imports it.
"""
