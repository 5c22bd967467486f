"""Operators for preparing text corpora: one module each, queries in ``queries``."""
