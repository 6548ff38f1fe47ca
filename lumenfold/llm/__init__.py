"""Operators for preparing training data: packing, language, token files, near-duplicates, quality, decontamination."""
