"""Structured Streaming: index insertion, frame sequences, windows."""
