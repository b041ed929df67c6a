"""Readers and parsers: each takes a DataFrame of raw text or JSON and returns typed rows."""
