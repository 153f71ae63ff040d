"""Structured Streaming: a live playlist as a source, and meters that run over unbounded tracks."""
