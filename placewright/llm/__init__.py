"""Operators for preparing training text: filters, rules, deduplication, decontamination, scoring, formatting, encoding.

Nothing else in the library imports this subpackage.
"""
