"""Operators for preparing training data: scans, rules, token counts, deduplication, archives, mixing and token files."""
