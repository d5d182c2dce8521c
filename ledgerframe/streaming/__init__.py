"""Message ports and transaction regions on Structured Streaming."""
