"""Structured Streaming wrappers; an addition, as the batch operators have no streaming counterpart to match."""
