"""The same rules on Structured Streaming input."""
