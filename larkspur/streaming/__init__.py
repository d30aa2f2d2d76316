"""Structured Streaming: chat sessions, artifact sinks and windowed counts."""
