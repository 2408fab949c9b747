"""Structured Streaming: the review log as a keyed state, cases, and pair requests scored as they come."""
