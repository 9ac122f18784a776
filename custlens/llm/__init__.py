"""Operators for preparing large text corpora, and the queries that apply them.

Nothing outside this package imports it; the driver entry adds its queries only
when the package is present.
"""
