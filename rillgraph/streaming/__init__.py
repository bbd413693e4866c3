"""Structured Streaming: files and lineage events into the graph store, event-time windows."""
