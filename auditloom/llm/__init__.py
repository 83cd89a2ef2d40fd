"""Operators for preparing text corpora: scans, filters, sketches, sampling, tokens and media."""
