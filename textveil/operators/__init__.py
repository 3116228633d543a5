"""Operators over DataFrames of texts, spans, payloads and mappings."""
