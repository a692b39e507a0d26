"""The owner-replacement protocol and standard event-time windows on Structured Streaming."""
