"""txgraph: transaction tables -> heterogeneous graphs and leak-free graph features on Spark."""

__version__ = "0.1.0"
