"""Event streams: inboxes, projections and their freshness, in batches and as Structured Streaming."""
