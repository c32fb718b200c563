"""Continuous subgraph matching over labelled, evolving graphs as Spark relational plans."""
