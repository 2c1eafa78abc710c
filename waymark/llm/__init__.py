"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it. ``catalog.py`` holds the thin
contract queries (``opN_<name>``); every other module is a general operator.
"""
