"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface; ``queries`` binds the operators to the given tables.
"""
