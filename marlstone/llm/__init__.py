"""Operators of a training-data pipeline over a ``documents`` table.

Nothing else in the package imports this subpackage.  ``QUERIES`` and
``ORACLES`` in ``marlstone.llm.registry`` hold its registered queries.
"""
