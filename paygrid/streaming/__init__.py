"""Structured Streaming operators (snapshot fold, snapshot dedup)."""
