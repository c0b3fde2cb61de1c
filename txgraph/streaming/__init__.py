"""txgraph.streaming."""
