"""Operators for building training corpora: quality, duplicates, language, mixing, rules, licences, packing, placement."""
