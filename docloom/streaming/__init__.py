"""docloom.streaming."""
