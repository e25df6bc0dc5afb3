"""Views of a stream of events, with Structured Streaming."""
