"""Operators for preparing training corpora: scans, deduplication, tokens, quality, sharding, decontamination."""
