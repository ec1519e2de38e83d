"""docloom.sources."""
