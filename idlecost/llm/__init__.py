"""Operators of a training-data pipeline over ``documents`` and ``conversations``.

Each module holds one operator with a general interface and the thin query that
applies it, with production parameters, to its whole table.  Nothing else in the
library imports this subpackage.
"""
