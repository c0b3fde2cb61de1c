"""txgraph.operators."""
