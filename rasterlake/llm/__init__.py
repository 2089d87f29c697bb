"""Operators for preparing training data, each a ``DataFrame -> DataFrame`` function.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
