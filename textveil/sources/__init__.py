"""Readers and writers: payloads, event streams, synthetic records."""
