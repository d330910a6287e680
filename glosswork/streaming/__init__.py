"""Transcripts that arrive as a stream."""
