"""Operators for text-corpus preparation: scoring, filters, deduplication, decontamination, mixing."""
