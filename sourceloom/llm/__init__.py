"""Preparation of training text: formatting, tokens, packing, near copies, quality and language.

Every operator takes a DataFrame and column names, reads only the columns it is given (further columns may have any
name), and is pickled by value with this package, so executors need no copy of it.
"""
