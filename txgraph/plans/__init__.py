"""txgraph.plans."""
