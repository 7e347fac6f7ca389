"""Operators for preparing training text: encoding, identification, filters, deduplication, search and scans.

Nothing else in the library imports this subpackage.
"""
