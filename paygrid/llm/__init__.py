"""Operators for preparing training text: packing, secret scans, quality,
decontamination, HTML extraction, language ID, deduplication, sharding."""
