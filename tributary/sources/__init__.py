"""Readers and writers of log, feature, run and prediction files.

Paths go through Spark's own readers and the session's file systems, never local calls.
"""
