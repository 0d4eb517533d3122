"""Operators for training-data pipelines over the ``documents`` table.

Nothing outside this subpackage imports it, and it imports nothing from the
rest of the library: it can be deleted as a folder.
"""
