"""Structured Streaming: the run log, and search statistics as pieces arrive."""
